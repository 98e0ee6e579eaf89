"""Problem 1: records that are the same but for formatting.

A record is a tree: an unordered node of fields whose values are text leaves or, for a text that is a JSON
object, nodes again. Digests go bottom-up: leaves are normalised, an unordered node hashes its children's
digests in sorted order, a list keeps its order. Records meet by their root digest; the full canonical
structure is compared within each digest before two records count as copies.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.functions import text as core_text
from promptloom.llm import sketch
from promptloom.operators.attach import attach
from promptloom.storage import written

_NODE = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("canon", T.StringType())])


class _Skip(dict):
    """Signs that are left out of account, by rule: white space and punctuation of all scripts."""

    def __missing__(self, cp: int):
        ch = chr(cp)
        self[cp] = None if ch.isspace() or unicodedata.category(ch)[0] == "P" else cp
        return self[cp]


_skip = _Skip()
_plain_key = re.compile(r"[\x00-\x1f]")


def _number(literal: str) -> Decimal | int:
    """A number's value: 1.50 is 1.5, and 2.0 is 2."""
    value = Decimal(literal).normalize()
    return int(value) if value == value.to_integral_value() and abs(value.adjusted()) < 4000 else value


def _leaf(value: object) -> str:
    """A text without letter case, white space and punctuation; a number keeps its sign and its decimal point."""
    if isinstance(value, (int, Decimal)) and not isinstance(value, bool):
        return str(value).lower()
    text = value if isinstance(value, str) else json.dumps(value)
    return text.lower().translate(_skip)


def _digest(tag: bytes, parts: list[bytes]) -> bytes:
    return hashlib.blake2b(tag + b"".join(parts), digest_size=16).digest()


def _node(value: object) -> tuple[bytes, str]:
    """Digest and canonical text of a tree. An object is a list of (field, value), marked as a tuple."""
    if isinstance(value, tuple):
        children = []
        for field, child in value:
            name = _leaf(field)
            digest, canon = _node(child)
            children.append((_digest(b"F", [_digest(b"L", [name.encode("utf-8", "replace")]), digest]), f"{name}\x01{canon}"))
        children.sort()
        return _digest(b"O", [d for d, _ in children]), "\x02" + "\x03".join(c for _, c in children) + "\x04"
    if isinstance(value, list):
        items = [_node(x) for x in value]
        return _digest(b"A", [d for d, _ in items]), "\x05" + "\x03".join(c for _, c in items) + "\x06"
    leaf = _plain_key.sub("", _leaf(value))
    return _digest(b"L", [leaf.encode("utf-8", "replace")]), leaf


def json_node(text: str | None) -> dict | None:
    """The node of a JSON object; null for any other text, and for an object nested deeper than the parser goes (some hundred
    levels), which is then compared as plain text."""
    if text is None:
        return None
    try:
        tree = json.loads(text, object_pairs_hook=tuple, parse_float=_number, strict=False)
        if not isinstance(tree, tuple) or text.strip()[:1] != "{":
            return None
        digest, canon = _node(tree)
    except (ValueError, ArithmeticError, RecursionError):
        return None
    h1, h2 = (int.from_bytes(digest[k : k + 8], "little", signed=True) for k in (0, 8))
    return {"h1": h1, "h2": h2, "canon": canon}


@F.arrow_udf(_NODE)
def _json_nodes(text: pa.Array) -> pa.Array:
    kind = pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("canon", pa.string())])
    return pa.array([json_node(x) for x in text.to_pylist()], kind)


def _records(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``id``, root digest ``h1, h2``, the canonical fields and the source's plain ``name`` of every row that can have copies."""
    rows = df.select(df[key].alias("id"), df[text].alias("text"), core_text.folded(df[source]).alias("source"), core_text.clean_name(df[source]).alias("name"))
    rows = rows.filter(F.col("source").isNotNull() & core_text.not_blank(F.col("text")))
    rows = rows.withColumn("node", _json_nodes(F.when(F.col("text").rlike(r"\A\s*\{"), F.col("text"))))
    rows = rows.withColumn("canon", F.coalesce("node.canon", core_text.folded(F.col("text"))))

    def child(k: int) -> Column:
        return F.coalesce(F.col(f"node.h{k}"), F.xxhash64(F.lit(k), "canon"))

    return rows.select("id", "source", "name", "canon", *(F.xxhash64(F.lit(k), F.xxhash64(F.lit(k), "source"), child(k)).alias(f"h{k}") for k in (1, 2)))


def _same(records: DataFrame) -> DataFrame:
    """One row for each distinct record. Grouping by digest and canonical fields together is the full comparison; equal rows collapse before
    the shuffle."""
    return records.groupBy("h1", "h2", "source", "canon").agg(F.min("id").alias("keep_id"), F.min("name").alias("name"), F.count(F.lit(1)).alias("n"))


def _met(records: DataFrame) -> DataFrame:
    """The digests of several rows: only digests are shuffled, not the records."""
    return written(records.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "digests")


def copies(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``keep_id, copy_id``: of each group of copies the smallest key, with each other member.

    Two rows are copies if source and text are the same without letter case, white space and punctuation; a
    text that is a JSON object is the same as one with the same fields and values, in whatever order. Its numbers
    are the same if their values are. A null source and a null or blank text never are. Exact repeats count. Texts of nothing but
    punctuation are the same. Invalid JSON is plain text. Should two different records have one digest, they stay apart.

    Rows meet by digest; the canonical fields of those that met, and a few others, are compared. A digest that has proved
    to stand for one record is all that its rows need to find their group; only other digests need the fields again.
    """
    records = written(_records(df, key, text, source), "records")
    met = _met(records)
    digests = _same(sketch.likely(records, met, "h1")).groupBy("h1", "h2").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("variants"))
    digests = written(digests.filter("n > 1"), "copy-groups")
    proved = digests.filter("variants = 1")
    found = attach(sketch.likely(records.select("id", "h1", "h2"), proved, "h1"), proved, ["h1", "h2"], [], ["keep_id"], spread=["id"])
    mixed = digests.filter("variants > 1")
    if not mixed.isEmpty():
        own = records.join(mixed.select("h1", "h2"), ["h1", "h2"], "left_semi")
        found = found.unionByName(attach(own, written(_same(own), "variants"), ["h1", "h2"], ["source", "canon"], ["keep_id"], spread=["id"]).select(*found.columns))
    return found.filter("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))


def copy_counts(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``keep_id, source, n_copies``: each distinct record once, by its smallest key, with its source's name and its number of rows.

    Of names of one source that differ in punctuation inside, the first in order. Records whose digest is theirs alone need no comparison.
    """
    records = written(_records(df, key, text, source), "records")
    alone = records.groupBy("h1", "h2").agg(F.min("id").alias("keep_id"), F.min("name").alias("name"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    met = _met(records)
    several = _same(sketch.likely(records, met, "h1")).join(met.select("h1", "h2"), ["h1", "h2"], "left_semi")
    return alone.select("keep_id", "name", "n").unionByName(several.select("keep_id", "name", "n")).select("keep_id", F.col("name").alias("source"), F.col("n").alias("n_copies"))
