"""Problem 10: passages that were read in a wrong character encoding.

Every distinct clean word of the corpus is garbled by all chains of wrong readings; the documents' suspicious
tokens are hash-joined with these forms, and a form that has one original is replaced by it. What no word
explains is put together from the garbled forms of the corpus's single letters. Words are the runs of
non-ASCII signs, as all chains leave ASCII as it is; garbling is a table look-up over the bytes of a batch.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.llm import arrowtext as at
from promptloom.llm import sketch
from promptloom.storage import written

LOST = 0xFFFD
# The encodings in which UTF-8 was read.
CODECS = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437")
#: Each chain: the encodings in which the bytes were read, one after the other. "?" reads an undefined byte as lost.
CHAINS = (*((c,) for c in CODECS), ("cp1252?",), ("cp1252", "cp1252"), ("latin-1", "latin-1"), ("cp1252", "latin-1"), ("latin-1", "cp1252"))
#: Texts of this encoding that were read as UTF-8: each of its bytes above ASCII is lost.
READ_AS_UTF8 = "cp1252"


@functools.cache
def code_table(codec: str) -> np.ndarray:
    """Code point of each byte; an undefined byte stays as it is, or is lost ("?")."""
    name, lossy = codec.rstrip("?"), codec.endswith("?")
    out = []
    for b in range(256):
        try:
            out.append(ord(bytes([b]).decode(name)))
        except UnicodeDecodeError:
            out.append(LOST if lossy else b)
    return np.array(out, np.uint32)


@functools.cache
def alphabet_of_western() -> np.ndarray:
    """The signs above ASCII that READ_AS_UTF8 has a byte for."""
    out = np.zeros(at.MAX_CP, bool)
    out[code_table(READ_AS_UTF8 + "?")[128:]] = True
    out[LOST] = False
    return out


@functools.cache
def alphabet() -> np.ndarray:
    """Which code points a chain can make of a byte above ASCII."""
    out = np.zeros(at.MAX_CP, bool)
    for codec in CODECS:
        out[code_table(codec)[128:]] = True
    out[LOST] = True
    out[:128] = False
    return out


def garbled(cps: np.ndarray, offs: np.ndarray, chain: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The forms of a batch of words under a chain."""
    for codec in chain:
        offs = at.offsets(at.utf8_lengths(cps))[offs]
        cps = code_table(codec)[at.to_utf8(cps)]
    return cps, offs


def runs(wanted: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of wanted signs within rows."""
    n = len(wanted)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.concatenate([[False], wanted])
    after = np.append(wanted, False)
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends


def suspicious(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that may be a form: runs of signs that a chain can make, of two signs at least or with a lost one."""
    made = alphabet()[cps]
    lost = at.offsets((cps == LOST).astype(np.int64))
    starts, ends = runs(made, offs)
    keep = (ends - starts > 1) & (lost[ends] - lost[starts] < ends - starts)
    if not lost[-1]:
        return starts[keep], ends[keep]
    # lost signs alone belong to the word of ASCII letters around them
    s2, e2 = runs(_letter(cps) | (cps == LOST), offs)
    edge = np.concatenate([[False], made, [False]])
    own = (lost[e2] > lost[s2]) & ~(edge[s2] & ~np.isin(s2, offs)) & ~(edge[e2 + 1] & ~np.isin(e2, offs))
    starts, ends = np.concatenate([starts[keep], s2[own]]), np.concatenate([ends[keep], e2[own]])
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


def _letter(cps: np.ndarray) -> np.ndarray:
    return ((cps | 0x20) >= 0x61) & ((cps | 0x20) <= 0x7A)


_TOKEN = T.StructType([T.StructField("doc", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("token", T.StringType())])
_FORM = T.StructType([T.StructField("hash", T.LongType()), T.StructField("form", T.StringType()), T.StructField("word", T.StringType()), T.StructField("made", T.BooleanType()), T.StructField("letter", T.IntegerType())])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b in at.slices(batch.column(1)):
            cps, offs = at.to_codepoints(batch.column(1).slice(a, b - a))
            starts, ends = suspicious(cps, offs)
            row = np.searchsorted(offs, starts, "right") - 1
            lens = ends - starts
            hashes = at.segment_hashes(cps, starts, ends).view(np.int64)
            text = at.from_codepoints(cps[at.ragged_index(starts, lens)], at.offsets(lens))
            yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][row]), pa.array((starts - offs[row]).astype(np.int32)), pa.array(hashes), text], ["doc", "start", "hash", "token"])


def _forms(batches: Iterator[pa.RecordBatch], filter_: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Forms of the distinct words that a suspicious token may equal; and the distinct letters, as words of their own."""
    seen: set[int] = set()
    letters = np.zeros(at.MAX_CP, bool)
    for batch in batches:
        for a, b in at.slices(batch.column(0)):
            cps, offs = at.to_codepoints(batch.column(0).slice(a, b - a))
            letters[cps] = True
            starts, ends = runs(cps > 127, offs)
            words, word_offs = _unseen(cps, starts, ends, seen)
            clean = np.diff(at.offsets((words == LOST).astype(np.int64))[word_offs]) == 0
            for chain in CHAINS:
                form, form_offs = garbled(words, word_offs, chain)
                yield from _hits(words, word_offs, form, form_offs, clean, filter_)
            western = alphabet_of_western()[cps]
            starts, ends = runs(western | _letter(cps), offs)
            some = at.offsets(western.astype(np.int64))
            keep = some[ends] > some[starts]
            words, word_offs = _unseen(cps, starts[keep], ends[keep], seen)
            yield from _hits(words, word_offs, np.where(words > 127, np.uint32(LOST), words), word_offs, np.ones(len(word_offs) - 1, bool), filter_)
    letters[:128] = False
    letters[LOST] = False
    cps = np.flatnonzero(letters).astype(np.int32)
    none = pa.nulls(len(cps), pa.string())
    yield pa.RecordBatch.from_arrays([pa.nulls(len(cps), pa.int64()), none, none, pa.nulls(len(cps), pa.bool_()), pa.array(cps)], _FORM.names)


def _unseen(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray, seen: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words that this task has not met, flat."""
    uniq, first = np.unique(at.segment_hashes(cps, starts, ends), return_index=True)
    if len(seen) > 1_000_000:  # speed only: a word may then be garbled again
        seen.clear()
    new = np.fromiter((h not in seen for h in uniq.tolist()), bool, len(uniq))
    seen.update(uniq[new].tolist())
    starts, lens = starts[first[new]], (ends - starts)[first[new]]
    return cps[at.ragged_index(starts, lens)], at.offsets(lens)


def _hits(words: np.ndarray, word_offs: np.ndarray, form: np.ndarray, form_offs: np.ndarray, clean: np.ndarray, filter_: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The words whose form passes the filter. ``made``: the word itself may be a form, so a plainer original goes first."""
    hashes = at.segment_hashes(form, form_offs[:-1], form_offs[1:])
    hit = np.flatnonzero(sketch.passes(filter_, hashes) & clean)
    if not len(hit):
        return
    size, own = np.diff(form_offs)[hit], np.diff(word_offs)[hit]
    strange = np.diff(at.offsets((alphabet()[words]).astype(np.int64))[word_offs])[hit]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(hashes[hit].view(np.int64)),
            at.from_codepoints(form[at.ragged_index(form_offs[hit], size)], at.offsets(size)),
            at.from_codepoints(words[at.ragged_index(word_offs[hit], own)], at.offsets(own)),
            pa.array((strange == own) & (own > 1)),
            pa.nulls(len(hit), pa.int32()),
        ],
        _FORM.names,
    )


def letter_forms(letters: list[int]) -> list[dict[str, str]]:
    """For each chain the forms of the letters; the last is that of letters whose every byte is lost."""
    letters = [x for x in letters if not 0xD800 <= x < 0xE000]
    cps = np.array(letters, np.uint32)
    out = []
    for chain in CHAINS:
        form, offs = garbled(cps, np.arange(len(cps) + 1), chain)
        text = at.from_codepoints(form, offs).to_pylist()
        table: dict[str, str] = {}
        for f, cp in zip(text, letters):
            table[f] = "" if f in table else chr(cp)  # one form of two letters restores neither
        out.append(table)
    return out


def spelt(token: str, tables: list[dict[str, str]]) -> tuple[bool, str | None]:
    """Whether the token is made of forms of letters, of one chain; and the original, if each form has one."""
    for table in sorted(tables, key=lambda t: -max(map(len, t), default=0)):  # readings one after the other before single ones
        longest = max(map(len, table), default=0)
        out, k, sure = [], 0, True
        while k < len(token):
            for size in range(min(longest, len(token) - k), 1, -1):
                letter = table.get(token[k : k + size])
                if letter is not None:
                    break
            else:
                break
            sure &= letter != ""
            out.append(letter)
            k += size
        if k == len(token):
            return True, "".join(out) if sure else None
    # a lost sign is what is left of a byte that the reader could not place
    return chr(LOST) in token, None


def passages(df: DataFrame, key: str, text: str) -> DataFrame:
    """``doc, start, token, word``: every token that was read in a wrong encoding, where it stands (in code points), and its
    original, null where it can't be restored (lost bytes, or several words of the corpus have this form).

    Null and empty texts have none. Repeats of a document are found each for itself. The forms of all words of
    all texts are made, but only those that pass a filter of fixed size over the suspicious tokens leave the worker.
    """
    docs = df.select(df[key].cast("bigint").alias("doc"), df[text].alias("text")).filter("text is not null and doc is not null")
    tokens = written(docs.mapInArrow(_tokens, _TOKEN), "suspicious")
    filter_ = sketch.collect_filter(tokens, F.col("hash"))
    forms = written(docs.select("text").mapInArrow(lambda batches: _forms(batches, filter_), _FORM), "forms")
    # one row for each code point that occurs: at most as many as there are code points
    tables = letter_forms(sorted(r.letter for r in forms.filter("letter is not null").select("letter").distinct().collect()))

    kind = T.StructType([T.StructField("hit", T.BooleanType()), T.StructField("word", T.StringType())])

    @F.arrow_udf(kind)
    def by_letters(token: pa.Array) -> pa.Array:
        rows = [(False, None) if x is None else spelt(x, tables) for x in token.to_pylist()]
        return pa.array([{"hit": a, "word": b} for a, b in rows], pa.struct([("hit", pa.bool_()), ("word", pa.string())]))

    words = forms.filter("letter is null").groupBy("hash", "form").agg(
        *(f(F.when(F.col("made") == m, F.col("word"))).alias(f"{n}{int(m)}") for m in (False, True) for n, f in (("lo", F.min), ("hi", F.max)))
    )
    words = words.select("hash", "form", F.coalesce("lo0", "lo1").alias("lo"), F.expr("case when lo0 is null then hi1 else hi0 end").alias("hi"))
    distinct = tokens.groupBy("hash", "token").agg(F.count(F.lit(1)).alias("n"))
    met = distinct.join(words, (distinct["hash"] == words["hash"]) & (distinct["token"] == words["form"]), "left").select(distinct["token"], "n", "lo", "hi")
    met = met.withColumn("rest", by_letters(F.when(F.col("lo").isNull(), F.col("token"))))
    met = met.filter("lo is not null or rest.hit").select("token", "n", F.expr("case when lo is null then rest.word when lo = hi then lo end").alias("word"))
    from promptloom.operators.attach import attach

    return attach(tokens.select("doc", "start", "token"), written(met, "originals"), ["token"], [], ["word"], spread=["doc", "start"])


def affected(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``: each document with at least one garbled passage, once."""
    return passages(df, key, text).select(F.col("doc").alias(key)).distinct()


def restored(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, n_passages, n_restored, restored_text``: the affected documents, each restorable token replaced by its original."""
    found = written(passages(df, key, text), "passages").groupBy("doc").agg(
        F.count(F.lit(1)).alias("n_passages"), F.count("word").alias("n_restored"), F.collect_list(F.when(F.col("word").isNotNull(), F.struct("start", F.length("token").alias("size"), "word"))).alias("edits")
    )

    @F.arrow_udf(T.StringType())
    def replace(text: pa.Array, edits: pa.Array) -> pa.Array:
        out = []
        for t, e in zip(text.to_pylist(), edits.to_pylist()):
            parts, k = [], 0
            for x in sorted(e or [], key=lambda x: x["start"]):
                parts += [t[k : x["start"]], x["word"]]
                k = x["start"] + x["size"]
            out.append("".join([*parts, t[k:]]))
        return pa.array(out, pa.string())

    found = written(found.withColumn("h", F.xxhash64("doc")), "edits")
    # only texts with edits, and a few others, are shuffled
    docs = sketch.likely(df.select(df[key].cast("bigint").alias("doc"), df[text].alias("text")).withColumn("h", F.xxhash64("doc")), found, "h").drop("h")
    return docs.join(found, "doc").select(F.col("doc").alias(key), "n_passages", "n_restored", replace("text", "edits").alias("restored_text"))
