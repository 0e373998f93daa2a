"""SpotSigs fingerprints: common words are anchors, and the content words that follow one form a signature.

DataFrame functions only. A document's fingerprint is the set of its signatures' hashes. Sets are compared by Jaccard's
measure: pairs are formed within bands of set length and pruned by length and by their rarest signatures before sets are intersected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcast.llm.common import ID, TEXT, column, documents, id_and_text
from fleetcast.session import written

#: Words so common that every page of running text has them, per language; a signature begins at one.
ANCHORS = (
    "a an and are is it of that the this to was with "
    "au des dans est et la le les par pour que un une "
    "das den der die ein eine ist mit nicht und von zu "
    "con de del el en es las los para por se y"
).split()
#: Further common words, which are neither anchors nor content.
OTHERS = "as at be by for from in on or were aux du il ne ou qui sur als auf dem für im sich al lo no su una".split()
#: Content words in a signature.
CHAIN = 2
SIMILARITY = 0.8
#: Least rows of a chunk in which documents are lined up to find the next one.
CHUNK = 2048


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """df with the sorted distinct signature hashes (32 bits) of a text column; a null text counts as empty.

    A text without an anchor that content follows has one signature, all its words; one without words has its own text as
    one; the empty text has none.
    """
    words, marked, parts, chains = (f"__{out}_{k}" for k in ("words", "marked", "parts", "chains"))
    low = F.lower(F.coalesce(F.col(text), F.lit("")))

    def mark(w: Column) -> Column:
        return F.when(w.isin(ANCHORS), F.concat(F.lit("\u0001"), w)).when(w.isin(OTHERS), F.lit("")).otherwise(w)

    def hashed(s: Column) -> Column:
        return F.xxhash64(s).bitwiseAND(F.lit(0xFFFFFFFF))

    # A lambda never looks at a whole array: the content of the next parts comes from shifted copies, joined element by element.
    following = F.col(chains)
    for k in range(1, chain):
        following = F.zip_with(following, F.slice(chains, k + 1, F.size(chains)), lambda a, b: F.concat_ws(" ", a, b))
    signed = F.zip_with(parts, following, lambda p, f: hashed(F.concat(F.substring_index(p, " ", 1), F.lit(":"), F.substring_index(f, " ", chain))))
    every = F.array_join(words, " ")
    alone = F.when(every != "", F.array(hashed(F.concat(F.lit(":"), every)))).when(low != "", F.array(hashed(low)))
    none = F.array().cast("array<bigint>")
    return (
        df.withColumn(words, F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: w != ""))
        .withColumn(marked, F.array_join(F.filter(F.transform(words, mark), lambda w: w != ""), " "))
        # what lies before the first anchor goes; each other part is an anchor and the content up to the next one
        .withColumn(parts, F.filter(F.transform(F.split(marked, "\u0001"), lambda p: F.rtrim(p)), lambda p, i: (i > 0) & p.contains(" ")))
        .withColumn(chains, F.transform(parts, lambda p: F.substr(p, F.locate(" ", p) + 1)))
        .withColumn(
            out,
            F.when(F.size(chains) > 0, F.sort_array(F.array_distinct(signed))).otherwise(F.coalesce(alone, none)),
        )
        .drop(words, marked, parts, chains)
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard's measure of two sets; two empty ones are alike. Sets of which one is empty need no intersection."""
    both = F.size(F.array_intersect(a, b))
    least, most = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, F.lit(1.0)).when(least == 0, F.lit(0.0)).otherwise(both / (least + most - both))


def told(signatures: Column) -> Column:
    """A set as a string: eight hexadecimal digits a signature, in order."""
    return F.array_join(F.transform(signatures, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0")), "")


def with_next(texts: DataFrame) -> DataFrame:
    """texts (doc_id, text) with next_text, that of the next document by descending doc_id; after the last comes the first.

    Ids are cut into ranges; a range's first document is copied to the end of the range before it, so each range finds its
    documents' successors by itself and texts move once. Null ids come last; rows of one id are ordered by their texts.
    """
    n, low, high = texts.agg(F.count("*"), F.min(ID), F.max(ID)).first()
    rows = max(CHUNK, math.isqrt(n))
    span = float(max(1, -(-((high or 0) - (low or 0) + 1) * rows // max(n, 1))))
    chunk = F.coalesce(F.floor((F.col(ID).cast("double") - F.lit(float(low or 0))) / F.lit(span)), F.lit(-1)).cast("long")
    # a row per range: about the square root of the number of documents at most
    ranges = texts.groupBy(chunk.alias("range")).agg(F.max(ID).alias("head"))
    line = Window.orderBy(F.desc("range"))
    before = F.coalesce(F.lag("range").over(line), F.min("range").over(Window.partitionBy()))
    heads = written(ranges.select("range", "head", before.alias("before")), "spot-ranges")
    placed = texts.withColumn("range", chunk).join(
        heads.withColumnRenamed("range", "r"), (F.col("range") == F.col("r")) & F.col(ID).eqNullSafe(F.col("head")), "left"
    )
    places = F.when(F.col("before").isNull(), F.array(F.struct(F.col("range"), F.lit(False).alias("copy")))).otherwise(
        F.array(F.struct(F.col("range"), F.lit(False).alias("copy")), F.struct(F.col("before").alias("range"), F.lit(True).alias("copy")))
    )
    order = Window.partitionBy("at.range").orderBy("at.copy", F.desc_nulls_last(ID), TEXT)
    return (
        placed.select(ID, TEXT, F.explode(places).alias("at"))
        .withColumn("next_text", F.lead(TEXT).over(order))
        .filter("not at.copy")
        .select(ID, TEXT, "next_text")
    )


def fingerprints(docs: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """doc_id and signatures of every row; repeated rows each give one."""
    return with_signatures(id_and_text(docs, id_col, text_col), TEXT, "signatures").select(ID, "signatures")


def near_links(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = ID, text_col: str = TEXT) -> tuple[DataFrame, DataFrame]:
    """(classes, links): classes has doc_id and class_id, the least doc_id of its fingerprint; links has left, right, likeness.

    Links are between classes whose sets' likeness is `similarity` or more. Two such sets share one of their rarest
    signatures, and their lengths differ by that factor at most: only sets that share a rare signature in one length band or in
    neighbouring ones are intersected, and documents of equal fingerprints are compared once.
    """
    found = written(fingerprints(docs, id_col, text_col).withColumn("key", F.sha2(F.to_json("signatures"), 256)), "spot-sets")
    sets = written(
        found.groupBy("key").agg(F.min(ID).alias("class_id"), F.first("signatures").alias("signatures"))
        .withColumn("n", F.size("signatures").cast("long")),
        "spot-classes",
    )
    classes = found.join(sets.select("key", "class_id"), "key").select(ID, "class_id")
    # the rarest n - ceil(similarity * n) + 1 signatures of a set: sets alike enough have one in common
    each = sets.select("key", "n", F.explode("signatures").alias("s"))
    ranked = each.join(written(each.groupBy("s").agg(F.count("*").alias("found")), "spot-counts"), "s")
    place = F.row_number().over(Window.partitionBy("key").orderBy("found", "s"))
    # least overlap of two sets of lengths n and m >= n is similarity / (1 + similarity) * (n + m), so at least similarity * n
    rare = ranked.withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1)
    band = F.floor(F.log("n") / math.log(1 / similarity)).cast("long")
    index = rare.filter("found > 1").select("key", "n", "s", band.alias("band"))
    longer = index.select(F.col("key").alias("right"), F.col("n").alias("m"), "s", "band")
    probes = index.select(F.col("key").alias("left"), "n", "s", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    ahead = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("left") < F.col("right")))
    pairs = (
        probes.join(longer, ["s", "band"])
        .filter(ahead & (F.col("n") >= F.col("m") * similarity - 1e-9))
        .select("left", "right")
        .distinct()
    )
    one, two = (sets.select(F.col("key").alias(k), F.col("class_id").alias(f"{k}_id"), F.col("signatures").alias(f"{k}_set")) for k in ("left", "right"))
    links = (
        pairs.join(one, "left").join(two, "right")
        .withColumn("likeness", likeness(F.col("left_set"), F.col("right_set")))
        .filter(F.col("likeness") >= similarity - 1e-9)
        .select(F.col("left_id").alias("left"), F.col("right_id").alias("right"), "likeness")
    )
    return classes, links


def op6(spark, sf_dir: str) -> DataFrame:
    rows = with_next(id_and_text(documents(spark, sf_dir)))
    text, after = F.coalesce(F.col(TEXT), F.lit("")), F.coalesce(F.col("next_text"), F.lit(""))
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), n - half), F.substring(after, F.lit(1), half))
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited": edited})
    for source, out in ((TEXT, "own"), ("edited", "changed"), ("next_text", "next")):
        rows = with_signatures(rows, source, out)
    return rows.select(
        ID, "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        told(F.col("own")).alias("fingerprint"), told(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
