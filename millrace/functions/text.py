"""Text and vocabulary functions as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import let
from .ordered import number_rows

# Characters that the word tokenizer deletes, those that it cuts at, and those that the separating tokenizer keeps as tokens.
DELETED = r"""[?!'"$:@(),.;]"""
CUT = "[-/]"
SEPARATORS = r"""[-.,!?:;"'()/$&%@#*\[\]{}<>|=+ \n]"""
#: The id of an answer that isn't in the vocabulary.
OUT_OF_VOCABULARY = 1999
UNKNOWN = "UNK"
# Data sets by split.
SPLITS = {"train": "train2014", "val": "val2014", "test": "test2015", "test-dev": "test2015"}


def tokenize_words(text: Column) -> Column:
    """Lower case; some punctuation deleted, dashes and slashes to spaces; the non-empty words."""
    return F.filter(F.split(F.regexp_replace(F.regexp_replace(F.lower(text), DELETED, ""), CUT, " "), " "), lambda x: F.length(x) > 0)


def tokenize_keeping(text: Column) -> Column:
    """Cut at separators, which are tokens themselves, except for spaces and line ends."""
    found = F.regexp_extract_all(text, F.lit(f"({SEPARATORS}|{'[^' + SEPARATORS[1:]}+)"), F.lit(1))
    return F.filter(found, lambda x: ~x.isin("", " ", "\n"))


def normalize_answer(text: Column) -> Column:
    return F.array_join(tokenize_words(text), " ")


def image_name(split: Column, image_id: Column) -> Column:
    return F.format_string("COCO_%s_%012d.jpg", split_name(split), image_id.cast("long"))


def split_name(split: Column) -> Column:
    out = split
    for short, full in SPLITS.items():
        out = F.when(split == short, F.lit(full)).otherwise(out)
    return out


def str2bool(text: Column) -> Column:
    """Null for anything that is neither yes nor no."""
    return F.try_to_boolean(text) if hasattr(F, "try_to_boolean") else F.expr("1 = 1") & text.try_cast("boolean")


def vocabulary(tokens: DataFrame, doc: str, position: str, word: str, above: int = 0) -> DataFrame:
    """(word, n, wid) of words that occur more than ``above`` times; ids from 1 in order of first occurrence (document ids are numbers or times)."""
    counted = tokens.groupBy(word).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col(doc).alias("d"), F.col(position).alias("p"))).alias("first")).where(F.col("n") > above)
    numbered = number_rows(counted.select(F.col(word).alias("word"), "n", F.col("first.d").alias("__d"), F.col("first.p").alias("__p")), "__d", ties=["__p"], out="wid")
    return numbered.select("word", "n", F.col("wid").cast("long"))


def encode(tokens: DataFrame, vocab: DataFrame, doc: str, position: str, word: str) -> DataFrame:
    """(doc, words, wids): every document's tokens in order; words outside the vocabulary become UNK with the next free id."""
    size = vocab.agg(F.coalesce(F.max("wid"), F.lit(0))).first()[0]
    known = tokens.join(vocab.select(F.col("word").alias("__w"), "wid"), F.col(word) == F.col("__w"), "left")
    item = F.struct(F.col(position).alias("p"), F.when(F.col("wid").isNotNull(), F.col(word)).otherwise(F.lit(UNKNOWN)).alias("w"), F.coalesce("wid", F.lit(size + 1).cast("long")).alias("i"))
    ordered = F.sort_array(F.collect_list(item))
    return known.groupBy(doc).agg(ordered.alias("s")).select(doc, F.transform("s", lambda x: x["w"]).alias("words"), F.transform("s", lambda x: x["i"]).alias("wids"))


def pad(ids: Column, length: int, left: bool = False) -> Column:
    """Clipped to ``length``, then padded with 0."""
    clipped = F.slice(ids, 1, length)
    fill = F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(length) - F.size(clipped), F.lit(0)))
    return F.concat(fill, clipped) if left else F.concat(clipped, fill)


def known_answers(answers: Column, ids: Column) -> Column:
    """From (answer, count) pairs and a map of answer ids: the pairs in the vocabulary as (answer, aid, count)."""
    kept = F.filter(answers, lambda x: F.map_contains_key(ids, x["answer"]))
    return F.transform(kept, lambda x: F.struct(x["answer"].alias("answer"), F.element_at(ids, x["answer"]).alias("aid"), x["count"].alias("count")))


def n_hot(ids: Column, counts: Column, size: int) -> Column:
    """The shares of ``counts`` at the places ``ids``."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x.cast("double"))
    pairs = F.arrays_zip(ids.alias("i"), counts.alias("c"))
    at = lambda p, k: F.aggregate(p, F.lit(0.0), lambda a, x: a + F.when(x["i"] == k, x["c"].cast("double")).otherwise(0.0))
    return let(total, lambda t: let(pairs, lambda p: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.when(t > 0, at(p, k) / t).otherwise(0.0))))


def sampled(items: Column, counts: Column, seed: int) -> Column:
    """An item drawn with probability by its count."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x.cast("double"))
    upto = F.aggregate(counts, F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x.cast("double"))))
    draw = F.rand(seed) * total
    place = F.array_position(F.transform(upto, lambda u: u > draw), True)
    return F.try_element_at(items, F.greatest(place, F.lit(1)).cast("int"))


def merged(base: Column, over: Column) -> Column:
    """Maps merged, the second winning."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def deep_update(base: dict, over: dict) -> dict:
    """Nested settings merged, the second winning."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_update(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def nested_pairs(df: DataFrame, key: str, items: str, fields: Sequence[str]) -> DataFrame:
    """One row an element of an array of structs."""
    return df.select(key, F.explode(items).alias("__i")).select(key, *(F.col(f"__i.{f}").alias(f) for f in fields))
