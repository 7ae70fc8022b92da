"""Sets of word shingles of whole texts, for many texts at once: exact codes to compare texts by, and hashes for sketches."""

import numpy as np
import pyarrow as pa
import xxhash

_RNG = np.random.default_rng(20240229)
_PLACE = _RNG.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit touches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normal(text: bytes) -> bytes:
    """The words of ``text``, A-Z lowered, with one space between them. Words are parted by space, tab, line feed, vertical
    tab, form feed and carriage return."""
    return b" ".join(text.lower().split())


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of normalised texts: all words' codes (equal for equal words alone), the codes' 64-bit hashes, each text's words."""
    raw = b"".join([x + b" " for x in texts if x])
    data = np.frombuffer(raw, np.uint8)
    ends = np.concatenate([[0], np.flatnonzero(data == 32) + 1])
    kinds = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in kinds.dictionary.to_pylist()], np.uint64)
    return kinds.indices.to_numpy().astype(np.int64), hashes, np.array([x.count(b" ") + 1 if x else 0 for x in texts], np.int64)


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of normalised texts: all their sets one after the other as codes, the sets' sizes, and the 64-bit hash of each code.

    Codes are equal for equal shingles alone, and only among the texts of one call; the hashes hold everywhere. A text with 1
    to k - 1 words has its whole sequence as its one shingle; one without words has the empty set."""
    word, hashes, n = words(texts)
    first, base = np.concatenate([[0], np.cumsum(n)]), max(len(hashes), 1)
    code, most = word.copy(), base
    for i in range(1, k):
        if most * base >= 1 << 62:
            kinds, code = np.unique(code, return_inverse=True)
            most = len(kinds)
        code = code[: len(word) - i] * base + word[i:] if len(word) > i else code[:0]
        most *= base
    own = hashes[word] if len(word) else np.zeros(0, np.uint64)
    every = np.zeros(len(code), np.uint64)
    for i in range(k):
        every += own[i : i + len(code)] * _PLACE[i]
    every = mix(every)
    sets, held, whole = [], [], {}
    for d, count in enumerate(n.tolist()):
        lo = first[d]
        if count >= k:
            own_codes, at = np.unique(code[lo : lo + count - k + 1], return_index=True)
            sets.append(own_codes)
            held.append(every[lo + at])
        elif count:  # codes below 0 name whole sequences
            sets.append(np.array([-1 - whole.setdefault(tuple(word[lo : lo + count].tolist()), len(whole))]))
            held.append(mix((own[lo : lo + count] * _PLACE[:count]).sum(keepdims=True, dtype=np.uint64) + _PLACE[63 - count]))
    sizes = np.where(n >= k, 0, np.minimum(n, 1))
    sizes[n > 0] = [*map(len, sets)]
    return np.concatenate([*sets, np.zeros(0, np.int64)]), sizes, np.concatenate([*held, np.zeros(0, np.uint64)])
