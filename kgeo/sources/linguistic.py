"""Text formats of linguistic resources as DataFrames. Every reader takes a path or a list of paths."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgeo.functions.text import clean_markup


def documents(spark: SparkSession, path: str) -> DataFrame:
    """A row per file: path, text."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """file, sent, id, lemma, head of CoNLL-U: blank lines part sentences; comments, ranges (1-2) and empty nodes (1.1) are left out.

    A file is read whole and cut into sentences at once, so no order between rows is needed."""
    sents = documents(spark, path).select("path", F.posexplode(F.split(F.regexp_replace("text", "\r", ""), r"\n\s*\n")).alias("sent", "block"))
    lines = sents.select("path", "sent", F.explode(F.split("block", "\n")).alias("line")).filter(~F.startswith("line", F.lit("#")) & (F.col("line") != ""))
    c = F.split("line", "\t")
    rows = lines.select("path", "sent", F.get(c, F.lit(0)).alias("id"), F.get(c, F.lit(2)).alias("lemma"), F.get(c, F.lit(6)).alias("head")).filter(F.col("id").rlike("^[0-9]+$"))
    return rows.select("path", "sent", F.col("id").cast("int").alias("id"), "lemma", F.expr("try_cast(head AS INT)").alias("head"))


def dependencies(words: DataFrame) -> DataFrame:
    """Pairs of a word and its head within the sentence, rated 1800, and of neighbours, rated 1500: a, b, elo."""
    heads = words.select("path", "sent", F.col("id").alias("head"), F.col("lemma").alias("b"))
    dep = words.join(heads, ["path", "sent", "head"]).select(F.col("lemma").alias("a"), "b", F.lit(1800).alias("elo"))
    nxt = words.select(F.col("lemma").alias("a"), F.lead("lemma").over(Window.partitionBy("path", "sent").orderBy("id")).alias("b"), F.lit(1500).alias("elo")).filter("b IS NOT NULL")
    return dep.unionByName(nxt).filter("a <> b")


def tatoeba_sentences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", quote="", schema="sid bigint, lang string, text string")


def tatoeba_links(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", quote="", schema="id1 bigint, id2 bigint")


def translations(sentences: DataFrame, links: DataFrame) -> DataFrame:
    """First words of linked sentences, place by place, up to four: a, b, elo (1400 for the first, then 1300)."""
    words = sentences.select("sid", F.slice(F.filter(F.split("text", r"[ \t]+"), lambda w: w != ""), 1, 4).alias("ws"))
    both = links.join(words.select(F.col("sid").alias("id1"), F.col("ws").alias("u")), "id1").join(words.select(F.col("sid").alias("id2"), F.col("ws").alias("v")), "id2")
    zipped = both.select(F.posexplode(F.slice(F.arrays_zip("u", "v"), F.lit(1), F.least(F.size("u"), F.size("v")))).alias("k", "p"))
    return zipped.select(F.col("p.u").alias("a"), F.col("p.v").alias("b"), F.when(F.col("k") == 0, 1400).otherwise(1300).alias("elo"))


def wordnet(spark: SparkSession, path: str) -> DataFrame:
    """offset, pos, lemmas, gloss, pointers of WordNet data files: the word count is hexadecimal; satellites are adjectives."""
    lines = spark.read.text(path).filter(F.col("value").rlike("^[0-9]{8} "))
    f = F.split(F.regexp_extract("value", r"^([^|]*)", 1), " ")
    n = F.conv(F.get(f, F.lit(3)), 16, 10).cast("int")
    p = F.expr("try_cast(get(f, 4 + 2 * n) AS INT)")
    pos = lambda c: F.when(c == "s", "a").otherwise(c)
    return (lines.select(f.alias("f"), n.alias("n"), F.trim(F.regexp_extract("value", r"\|(.*)$", 1)).alias("gloss")).withColumn("p", p)
        .select(F.get("f", F.lit(0)).alias("offset"), pos(F.get("f", F.lit(2))).alias("pos"), F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.regexp_replace(F.get("f", 4 + 2 * i), "_", " ")).alias("lemmas"), "gloss",
            F.when(F.col("p") > 0, F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda i: F.struct(F.get("f", 5 + 2 * F.col("n") + 4 * i).alias("type"), F.get("f", 6 + 2 * F.col("n") + 4 * i).alias("target_offset"), pos(F.get("f", 7 + 2 * F.col("n") + 4 * i)).alias("target_pos")))).otherwise(F.array().cast("array<struct<type:string,target_offset:string,target_pos:string>>")).alias("pointers")))


def wordnet_relations(synsets: DataFrame) -> DataFrame:
    """Synonyms (1900), pointers to the target's first lemma (1700): a, b, kind, elo."""
    syn = synsets.select(F.get("lemmas", F.lit(0)).alias("a"), F.explode(F.slice("lemmas", 2, 1000)).alias("b"), F.lit("synonym").alias("kind"), F.lit(1900).alias("elo"))
    to = synsets.select(F.col("offset").alias("target_offset"), F.col("pos").alias("target_pos"), F.get("lemmas", F.lit(0)).alias("b"))
    ptr = synsets.select(F.get("lemmas", F.lit(0)).alias("a"), F.explode("pointers").alias("p")).select("a", "p.*").join(to, ["target_offset", "target_pos"]).select("a", "b", F.col("type").alias("kind"), F.lit(1700).alias("elo"))
    return syn.unionByName(ptr).filter("a <> b")


def omw(spark: SparkSession, path: str) -> DataFrame:
    """synset_id, lemma of .tab files: comments left out, white space trimmed, repeats once."""
    lines = spark.read.text(path).filter(~F.startswith("value", F.lit("#")))
    c = F.split("value", "\t")
    return lines.select(F.trim(F.get(c, F.lit(0))).alias("synset_id"), F.trim(F.get(c, F.lit(2))).alias("lemma")).filter("lemma IS NOT NULL AND lemma <> ''").dropDuplicates()


def wiktionary(spark: SparkSession, path: str) -> DataFrame:
    """title, ns, text of a dump's pages in namespaces 0, 14 and 110."""
    pages = spark.read.format("xml").option("rowTag", "page").schema("title string, ns int, revision struct<text: string>").load(path)
    return pages.select("title", "ns", F.col("revision.text").alias("text")).filter(F.col("ns").isin(0, 14, 110))


#: Rating by kind of Wiktionary relation.
WIKTIONARY_ELO = {"syn": 1950, "ant": 1900, "hyper": 1850, "hypo": 1850, "mero": 1800, "holo": 1800, "der": 1700, "rel": 1600, "cot": 1600, "definition": 1900, "category": 1200}


def wiktionary_relations(pages: DataFrame) -> DataFrame:
    """From the English section: relation templates, categories and definitions: a, b, kind, elo."""
    english = pages.select("title", F.regexp_extract("text", r"(?s)==English==(.*?)(?:\n==[^=]|\z)", 1).alias("t"))
    templates = english.select("title", F.explode(F.regexp_extract_all("t", F.lit(r"\{\{((?:syn|ant|hyper|hypo|mero|holo|der|rel|cot)\|en\|[^{}]*)\}\}"), F.lit(1))).alias("x")).select("title", F.split("x", r"\|").alias("p"))
    rel = templates.select("title", F.get("p", F.lit(0)).alias("kind"), F.explode(F.slice("p", 3, 1000)).alias("b")).filter(~F.col("b").contains("=") & (F.col("b") != ""))
    cat = english.select("title", F.lit("category").alias("kind"), F.explode(F.regexp_extract_all("t", F.lit(r"\[\[Category:([^\]|]*)"), F.lit(1))).alias("b"))
    dfn = english.select("title", F.lit("definition").alias("kind"), F.explode(F.regexp_extract_all("t", F.lit(r"(?m)^# (.*)$"), F.lit(1))).alias("b")).withColumn("b", clean_markup(F.col("b"))).filter("b <> ''")
    elo = F.create_map(*[x for k, v in WIKTIONARY_ELO.items() for x in (F.lit(k), F.lit(v))])
    return rel.unionByName(cat).unionByName(dfn).select(F.col("title").alias("a"), "b", "kind", F.get(F.array(elo[F.col("kind")]), F.lit(0)).alias("elo"))
