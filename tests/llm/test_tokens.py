"""Token encoders, records, packing and chat formatting against the libraries and by round trip."""

import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer as Library  # noqa: E402

from kgeo.llm import bpe, chat, chunks, packing, token_records  # noqa: E402
from kgeo.llm.storage import fresh_dir  # noqa: E402

ODD = ["", " ", "\n", "a   b", "foo \n\n bar", "x\x1c !\x1c y", "Don't STOP's 12,000 l'été. İstanbul ΑΣ σΣ!", "  lead", "trail \n", "a\r\nb\tc  d", "日本語 テスト。hello世界!!", "foo \n bar", "'tis it's, I'LL!'s", "🎉🎉 ok—,x", "½ ² ª µ ß ẞ", "a\xa0\xa0 b\xa0\n\nc", "w" * 5000, "to be or not " * 3000, "\nx\n\ny", "\x01 a\x01 b \x01", "ŉ. ſ, ÷. ×,"]
SPECIAL = ["<|endoftext|> x", "A<|EndOfText|>b<|endoftext|>. c<|startoftext|><|endoftext|>", "<|endoftext|>", " <|endoftext|> <|endoftext|>\n"]


def thue_morse(n: int) -> tuple[str, str]:
    """Two different words that hash alike in any polynomial hash modulo 2**64 from 1,024 characters on."""
    bits = [bin(i).count("1") & 1 for i in range(1 << n)]
    return "".join("AB"[b] for b in bits), "".join("BA"[b] for b in bits)


def texts() -> list[str]:
    rng = random.Random(3)
    parts = ["a", "b", " ", "é", "\n", "\t", ".", ",", "'s", "!", "1", "\u3000", "\u0301", "ß", "A", "\x1c", "Z", "\x01", "\xa0", "&&&", "ē", "\u2009"]
    return [*ODD, "x {} {} y".format(*thue_morse(11)), *("".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500))]


def encoded(enc, all_: list, size: int) -> list[list[int]]:
    """The ids of each text, worked off in ranges of rows."""
    column, out = pa.array(all_, pa.string()), []
    for lo, hi in chunks.row_ranges(chunks.utf8(column)[1], size):
        ids, ends = enc.ids(column.slice(lo, hi - lo))
        out += [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return out


@pytest.mark.parametrize(("name", "keeps"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_stretches_give_the_library_s_ids(name, keeps):
    from tokenizers import Tokenizer

    library, all_ = Tokenizer.from_file(tokenizers.path(name)), texts() + SPECIAL
    for limit, size in ((1 << 14, 300), (1 << 20, 1 << 20)):
        for x, got in zip(all_, encoded(chunks.StretchEncoder(tokenizers.path(name), keeps, limit), all_, size), strict=True):
            assert got == library.encode(x, add_special_tokens=False).ids, x
    library.encode_special_tokens = True
    for x, got in zip(all_, encoded(chunks.StretchEncoder(tokenizers.path(name), keeps, special=False), all_, 1 << 20), strict=True):
        assert got == library.encode(x, add_special_tokens=False).ids, x
    assert encoded(chunks.StretchEncoder(tokenizers.path(name), keeps), [None, "", "a", None], 1) == [[], [], library.encode("a", add_special_tokens=False).ids, []]


@pytest.mark.parametrize(("name", "keeps"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_a_megabyte_without_a_gap(name, keeps):
    from tokenizers import Tokenizer

    x = "ab1,;" * 200_000
    assert encoded(chunks.StretchEncoder(tokenizers.path(name), keeps), [x], 1 << 20) == [Tokenizer.from_file(tokenizers.path(name)).encode(x, add_special_tokens=False).ids]


def test_perfect_hash_is_minimal_and_exact():
    keys = [str(i * 7919).encode() for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert [h.get(k) for k in keys] == [*range(3000)] and h.get(b"no") == -1 and h.n == len(set(h.at)) == 3000
    assert bpe.PerfectHash([]).get(b"x") == -1


def test_bpe_is_tiktoken(spark):
    import tiktoken

    enc = bpe.worker_encoder(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    for x in texts() + SPECIAL:
        ids = enc.encode(x)
        assert ids == own.encode_ordinary(x), x
        assert enc.decode(ids).decode() == x
    df = spark.createDataFrame([(1, "a b", "z"), (2, None, None), (None, "a b", "q"), (2, "é", "")], "doc_id long, text string, ids string")
    path = (tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    back = {(r.doc_id, bytes(r.data)) for r in bpe.decode_column(bpe.encode_column(df, *path), *path).collect()}
    assert back == {(1, b"a b"), (2, b""), (None, b"a b"), (2, "é".encode())}
    got = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.digests(df, *path).collect()}
    assert (2, 0, hashlib.sha256(b"").hexdigest()) in got and len(got) == 4
    assert bpe.digests(df.limit(0), *path).count() == 0


def test_bpe_is_linear_in_a_text_without_gaps():
    import tiktoken

    enc, x = bpe.worker_encoder(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN), "ab1,;" * 200_000
    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    began = time.process_time()
    ids = enc.encode(x)
    assert time.process_time() - began < 30
    assert ids == own.encode_ordinary(x)


def test_records_round_trip(spark):
    rows = [(5, "Hello world"), (-3, None), (9, "a b c"), (None, "x"), (9, "a b c"), (7, ""), (8, "le mot " * 2000), (11, "a<|endoftext|>b"), (12, " ".join(thue_morse(10)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' AS start", "1 AS n_tokens")
    out = fresh_dir(spark, "test-records")
    token_records.write_token_records(df, out, tokenizers.path("word_bpe_49k.json"), 2, shards=3)
    got = [tuple(r) for r in token_records.read_token_records(spark, out).orderBy("start").collect()]
    lib = Library.from_file(tokenizers.path("word_bpe_49k.json"))
    at, want = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    empty = fresh_dir(spark, "test-records")
    token_records.write_token_records(df.limit(0), empty, tokenizers.path("word_bpe_49k.json"), 2)
    assert token_records.read_token_records(spark, empty).count() == 0


def test_a_damaged_record_is_refused():
    good = b"".join(token_records.frame(b"abcdef"))
    assert bytes(token_records.unframe(memoryview(good), 0)[0]) == b"abcdef"
    for at in range(len(good)):
        with pytest.raises(ValueError):
            token_records.unframe(memoryview(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :]), 0)


def check_bins(lengths, bins, room):
    seen = {}
    for b in bins:
        size = sum(n for _, _, n in b)
        assert 0 < size <= room and all(n > 0 for _, _, n in b)
        for item, start, n in b:
            seen.setdefault(item, []).append((start, n))
    for item, n in enumerate(lengths):
        at = 0
        for start, size in sorted(seen.get(item, [])):
            assert start == at
            at += size
        assert at == n
    sizes = [sum(n for _, _, n in b) for b in bins]
    assert all(s == room or s & (s - 1) == 0 for s in sizes)


def test_pack_places_every_token_once():
    rng = random.Random(1)
    for case in ([], [0], [1], [1024] * 3, [1025], [5000, 1, 1023], [700] * 9):
        check_bins(case, packing.pack(case, 1024), 1024)
    for _ in range(60):
        lengths = [rng.choice([0, 1, rng.randint(1, 300), rng.randint(1, 5000)]) for _ in range(rng.randint(1, 80))]
        check_bins(lengths, packing.pack(lengths, 1024), 1024)


def test_tournament_tree_is_first_fit():
    rng = random.Random(2)
    tree, free = packing.CapacityTree(40, 100), [100] * 64
    for _ in range(60):
        size = rng.randint(1, 60)
        if any(f >= size for f in free):
            want = next(i for i, f in enumerate(free) if f >= size)
            assert tree.first_fit(size) == want
            free[want] -= size


def test_packed_documents_hold_all_ids(spark):
    rows = [(i, "the cat sat. " * (i * 13 % 400)) for i in range(60)] + [(None, "x y"), (3, "again"), (61, None), (62, "long one " * 5000), (62, "long one " * 5000), (63, "<|endoftext|>x"), (64, "x " + " ".join(thue_morse(10)) + " y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS part", "'s' AS offset")
    got = packing.pack_documents(df, tokenizers.path("byte_bpe_50k.json"), 0, group_docs=16, with_ids=True).collect()
    lib = Library.from_file(tokenizers.path("byte_bpe_50k.json"))
    want = sorted((d is not None, d or 0, i) for d, t in rows for i in lib.encode(t or "", add_special_tokens=False).ids + [0])
    assert sorted((r.doc_id is not None, r.doc_id or 0, i) for r in got for i in r.ids) == want
    by = {}
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack_documents(df.limit(0), tokenizers.path("byte_bpe_50k.json"), 0).count() == 0


def test_packing_takes_texts_a_little_at_a_time(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        packing.op7_packing(spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    ends = np.arange(0, 40 << 20, 4000)
    assert max(ends[hi] - ends[lo] for lo, hi in chunks.row_ranges(ends, packing.RANGE)) <= 1 << 21


def test_escaping_is_reversible():
    f, rng = chat.Formatter(chat.Template()), random.Random(4)
    parts = f.t.controls() + ["\\", "a", "<", "[", "\n", "é"]
    for _ in range(2000):
        role, x = rng.choice(["user", "assistant", "system", "tool", "", "[INST]"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        assert f.unescape(f.escape(x)) == x
        assert f.turns_of("".join(s for s, _ in f.segments(role, x))) == [(role, x)]


def test_chat_reads_back_every_turn(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "assistant", "a</s>"), (2, 0, "assistant", "a</s>"), (None, 1, "user", "z"), (3, None, None, "b"), (3, 2, "tool", "[INST]\\"), (4, 1, "user", "u" * 50_000), (4, 0, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS segment", "true AS loss")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    key = lambda r: tuple((v is not None, v if v is not None else 0) for v in r[1:])
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        said = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert got[1].valid and got[4].valid and got[2].problem == "assistant after start" and not got[3].valid and key
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
