"""Text as column expressions: tokens, keywords, runs, patterns, trigrams, classes of words and prompts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code blocks whose characters are each a token of their own (Hiragana, Katakana, CJK, compatibility, Hangul).
SINGLE = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{AC00}-\x{D7AF}"
#: Words left out of keywords.
KEYWORD_STOPS = "what is the a an of in to for on with at by from as and or but not this that these those".split()
#: Words left out of a problem's keywords.
PROBLEM_STOPS = "what is the a an of in to for on with at by from as and or but not how why can do does did will would could should this that".split()
#: Function words.
FUNCTION_WORDS = (
    "the a an of in to is and or but not for on with at by from as that this it was were be been being have has had do does did will would could should "
    "may might shall can are am its his her he she they them their we our you your my me him us who whom which what where when how why if so no than then "
    "there here these those itself himself herself themselves myself yourself"
).split()
#: How questions and creative prompts begin or what they hold.
QUESTION_STARTS = ["what ", "who ", "where ", "when ", "why ", "how ", "is ", "are ", "was ", "were ", "do ", "does ", "did ", "can ", "could ", "would ", "should ", "will ", "tell me", "explain", "describe"]
CREATIVE_MARKS = ["write ", "compose ", "create ", "generate ", "imagine ", "story ", "poem ", "essay ", "tell me a ", "once upon"]
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def char(cp: Column) -> Column:
    """The character of a codepoint (``chr`` stops at 255)."""
    return F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")


def codepoints(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def tokens(text: Column) -> Column:
    """Runs between spaces, tabs and line ends; characters of the SINGLE blocks alone. Punctuation stays."""
    return F.regexp_extract_all(text, F.lit(f"([{SINGLE}]|[^ \\t\\n\\r{SINGLE}]+)"), F.lit(1))


def keywords(text: Column, stops: list[str] | None = None) -> Column:
    """Words without ASCII punctuation and in lower case, in order, with repeats, stop words left out."""
    words = F.transform(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda w: F.lower(F.regexp_replace(w, PUNCTUATION, "")))
    return F.filter(words, lambda w: (w != "") & ~w.isin(KEYWORD_STOPS if stops is None else stops))


def runs(text: Column) -> Column:
    """Run-length code of the characters: (ordinal, ch, occurrences), the ordinal being where the run starts."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    begins = F.filter(F.sequence(F.lit(0), F.size(chars) - 1), lambda i: (i == 0) | (F.get(chars, i) != F.get(chars, i - 1)))
    made = F.transform(begins, lambda b, k: F.struct(b.alias("ordinal"), F.get(chars, b).alias("ch"), (F.coalesce(F.get(begins, k + 1), F.size(chars)) - b).alias("occurrences")))
    return F.when(F.size(chars) > 0, made).otherwise(F.array().cast("array<struct<ordinal:int,ch:string,occurrences:int>>"))


def unrun(coded: Column) -> Column:
    return F.array_join(F.transform(coded, lambda r: F.repeat(r["ch"], r["occurrences"])), "")


def pattern(text: Column) -> Column:
    """Which characters are alike: abba to XYYX; '' for up to one character. Symbols: X, Y, Z, then a, b, ..."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    kinds = F.array_distinct(chars)
    symbol = lambda i: F.when(i <= 3, F.substring(F.lit("XYZ"), i.cast("int"), F.lit(1))).otherwise(char((i + 93).cast("int")))
    return F.when(F.size(chars) <= 1, "").otherwise(F.array_join(F.transform(chars, lambda c: symbol(F.array_position(kinds, c))), ""))


def is_run(text: Column) -> Column:
    return (F.length(text) >= 2) & (F.size(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))) == 1)


def trigrams(text: Column) -> Column:
    """The set of trigrams of its words (letters and digits, lower case), each with two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all; 0 if there are none."""
    x, y = trigrams(a), trigrams(b)
    all_ = F.size(F.array_union(x, y))
    return F.when(all_ == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / all_)


def is_proper(text: Column) -> Column:
    return text.rlike("^[A-Z]")


def is_artifact(text: Column) -> Column:
    """Vocabulary entries of models that are no text: empty, [unused..], [PAD], ##x, and # before other than a letter."""
    return (text == "") | text.rlike(r"^\[unused") | text.isin("[PAD]", "[CLS]", "[SEP]", "[MASK]", "[UNK]") | F.startswith(text, F.lit("##")) | text.rlike("^#[^A-Za-z]")


def is_function_word(text: Column) -> Column:
    return (text == "") | ((F.length(text) == 1) & ~text.rlike("^[A-Za-z0-9]")) | F.lower(text).isin(FUNCTION_WORDS)


def is_question(text: Column) -> Column:
    low = F.lower(text)
    return F.endswith(text, F.lit("?")) | F.exists(F.array(*map(F.lit, QUESTION_STARTS)), lambda p: F.startswith(low, p))


def is_creative(text: Column) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*map(F.lit, CREATIVE_MARKS)), lambda p: F.contains(low, p))


def sentence(words: Column) -> Column:
    """Words to a sentence: no repeats one after the other, no space before single punctuation, a capital and a final stop."""
    kept = F.filter(F.transform(words, lambda w, i: F.when((i == 0) | (w != F.get(words, i - 1)), w)), lambda w: w.isNotNull())
    joined = F.array_join(F.transform(kept, lambda w: F.when(w.rlike(f"^{PUNCTUATION}$"), w).otherwise(F.concat(F.lit(" "), w))), "")
    text = F.ltrim(joined)
    capital = F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))
    return F.when(text == "", "").when(text.rlike(r"[.!?]$"), capital).otherwise(F.concat(capital, F.lit(".")))


def clean_markup(text: Column) -> Column:
    """Wiki text to plain text: templates and tags go, links give their label, bold and italics go, entities are resolved."""
    out = text
    for pattern_, by in ((r"\{\{[^{}]*\}\}", ""), (r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1"), (r"'{2,}", ""), (r"<[^>]*>", ""), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.regexp_replace(out, pattern_, by)
    return F.trim(out)


#: First and last codepoint and class, the first that holds counts.
CODEPOINT_CLASSES = [
    (0x41, 0x5A, "LatinUppercase"), (0x61, 0x7A, "LatinLowercase"), (0x30, 0x39, "Digits"), (0x20, 0x20, "Whitespace"), (0x09, 0x0A, "Whitespace"), (0x0D, 0x0D, "Whitespace"),
    (0x20, 0x2F, "PunctuationCommon"), (0x3A, 0x40, "PunctuationCommon"), (0x5B, 0x60, "PunctuationCommon"), (0x7B, 0x7E, "PunctuationCommon"), (0x00, 0x1F, "ControlCharacters"), (0x7F, 0x9F, "ControlCharacters"),
    (0xC0, 0xD6, "LatinUppercase"), (0xD8, 0xDE, "LatinUppercase"), (0xE0, 0xF6, "LatinLowercase"), (0xF8, 0xFF, "LatinLowercase"), (0x0391, 0x03A9, "GreekUppercase"), (0x03B1, 0x03C9, "GreekLowercase"),
    (0x0410, 0x042F, "CyrillicUppercase"), (0x0430, 0x044F, "CyrillicLowercase"), (0x4E00, 0x9FFF, "CJKIdeographs"), (0x3040, 0x309F, "Hiragana"), (0x30A0, 0x30FF, "Katakana"), (0xAC00, 0xD7AF, "Hangul"),
    (0x1F600, 0x1F64F, "EmojiSmileys"), (0x1F300, 0x1F5FF, "EmojiSymbols"), (0x1F900, 0x1F9FF, "EmojiPeople"), (0xD800, 0xDFFF, "Surrogates"), (0xE000, 0xF8FF, "PrivateUse"),
]


def codepoint_class(cp: Column) -> Column:
    out = F.lit("Unassigned")
    for low, high, name in reversed(CODEPOINT_CLASSES):
        out = F.when(cp.between(low, high), name).otherwise(out)
    return out


def class_similarity(a: Column, b: Column) -> Column:
    """1 for one class, 0.8 for the two cases of Latin, 0.6 for punctuation of both kinds, 0.1 else."""
    both = lambda names: a.isin(names) & b.isin(names)
    return F.when(a == b, 1.0).when(both(["LatinUppercase", "LatinLowercase"]), 0.8).when(both(["PunctuationCommon", "PunctuationRare"]), 0.6).otherwise(0.1)
