"""Problem 2: one consistent form for texts that look alike.

A batch of texts is a flat code-point array. Look-up tables replace each code point by zero, one or more
(full-width and font variants, look-alike letters, invisible signs, special blanks); marks are put in
canonical order and composed, all with array operations over the whole batch.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.functions import text as core_text
from promptloom.llm import arrowtext as at
from promptloom.llm import sketch
from promptloom.operators.attach import attach
from promptloom.storage import written

# Letters that are drawn like a plain Latin letter, and that letter.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "З": "3", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "Ү": "Y", "Ѵ": "V", "Ӏ": "I", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "һ": "h", "і": "i", "ј": "j", "ԛ": "q", "о": "o", "р": "p", "с": "c", "ѕ": "s", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "ԁ": "d", "ү": "y", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "γ": "y", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "υ": "u", "ϲ": "c", "ϳ": "j",
    "Լ": "L", "Ս": "U", "Տ": "S", "Օ": "O", "զ": "q", "հ": "h", "յ": "j", "ո": "n", "ս": "u", "ց": "g", "օ": "o",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭹ": "y", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮞ": "4", "Ꮟ": "b", "Ꮢ": "R",
    "Ꮤ": "W", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "ɑ": "a", "ɡ": "g", "ɩ": "i", "ɪ": "i", "ı": "i", "ƅ": "b", "ǀ": "l", "ℓ": "l", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s",
    "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
}
# Arabic letters that are drawn like a letter of Urdu.
ARABIC_ALIKES = {"ي": "ی", "ى": "ی", "ك": "ک"}
# A vowel letter written as another one and a vowel sign.
VOWEL_SEQUENCES = {
    "অা": "আ", "ঋৃ": "ৠ", "ঌৢ": "ৡ", "अा": "आ", "अॉ": "ऑ", "अॊ": "ऒ", "अो": "ओ", "अौ": "औ", "अॅ": "ॲ", "आॅ": "ऑ", "आॆ": "ऒ", "आे": "ओ", "आै": "औ",
    "उु": "ऊ", "एॅ": "ऍ", "एॆ": "ऎ", "एे": "ऐ",
}
_SAME_LOOK = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
_INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
_ALIKE = {ord(a): ord(b) for a, b in ARABIC_ALIKES.items()}
#: Kinds of signs within words: Latin letters, look-alikes of one, other letters, marks.
_LATIN, _FOREIGN, _OTHER, _MARK = 1, 2, 3, 4


def _kind(cp: int) -> int:
    ch = chr(cp)
    if ch in LOOK_ALIKES:
        return _FOREIGN
    group = unicodedata.category(ch)[0]
    return _MARK if group == "M" else 0 if group != "L" else _LATIN if unicodedata.name(ch, "").startswith("LATIN") else _OTHER


def _expansion(cp: int) -> list[int]:
    """What a code point becomes: canonical parts of its plain look, or nothing."""
    ch = chr(cp)
    if cp in _INVISIBLE or unicodedata.category(ch) == "Cf":
        return []
    if ch.isspace():
        return [cp if cp in (0x0A, 0x0D, 0x09) else 0x20]
    kind = unicodedata.decomposition(ch)
    if kind.startswith("<") and (kind.split()[0] in _SAME_LOOK or (kind.startswith("<compat>") and ch.isalpha() and ch.isascii() is False and "LIGATURE" in unicodedata.name(ch, ""))):
        parts = [y for x in kind.split()[1:] for y in _expansion(int(x, 16))]
    else:
        parts = [ord(x) for x in unicodedata.normalize("NFD", ch)]
    return [_ALIKE.get(x, x) for x in parts]


class _Tables:
    """Expansions and combining classes, filled by rule for code points as they come; compositions of pairs."""

    def __init__(self):
        self.known = np.zeros(at.MAX_CP, bool)
        self.first = np.zeros(at.MAX_CP, np.int32)
        self.size = np.zeros(at.MAX_CP, np.int8)
        self.mark = np.zeros(at.MAX_CP, np.uint8)
        self.pool = np.zeros(0, np.uint32)
        pairs: dict[tuple[int, int], int] = {}
        for k in range(11_172):  # syllables of Hangul: two letters, or a syllable of two and a last letter
            pairs[(0x1100 + k // 588, 0x1161 + k % 588 // 28) if k % 28 == 0 else (0xAC00 + k - k % 28, 0x11A7 + k % 28)] = 0xAC00 + k
        for cp in range(0xC0, 0x30000):
            parts = unicodedata.decomposition(chr(cp)).split()
            if len(parts) == 2 and parts[0][0] != "<":
                a, b = (int(x, 16) for x in parts)
                if unicodedata.normalize("NFC", chr(a) + chr(b)) == chr(cp):
                    pairs[a, b] = cp
        pairs |= {(ord(s[0]), ord(s[1])): ord(c) for s, c in VOWEL_SEQUENCES.items()}
        keys = np.array([(a << 21) | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_made = keys[order], np.array(list(pairs.values()), np.uint32)[order]
        self.second = np.zeros(at.MAX_CP, bool)
        self.second[[b for _, b in pairs]] = True
        self.alike = np.arange(at.MAX_CP, dtype=np.uint32)
        for a, b in LOOK_ALIKES.items():
            self.alike[ord(a)] = ord(b)
        self.kind = np.zeros(at.MAX_CP, np.uint8)

    def learn(self, cps: np.ndarray) -> None:
        seen = np.zeros(at.MAX_CP, bool)
        seen[cps] = True
        new = np.flatnonzero(seen & ~self.known)
        if not len(new):
            return
        parts = [_expansion(cp) for cp in new.tolist()]
        self.size[new] = [len(p) for p in parts]
        self.first[new] = len(self.pool) + at.offsets(self.size[new].astype(np.int64))[:-1]
        self.pool = np.concatenate([self.pool, np.array([x for p in parts for x in p], np.uint32)])
        made = {x for p in parts for x in p}
        for cp in made:
            self.mark[cp] = unicodedata.combining(chr(cp))
            self.kind[cp] = _kind(cp)
        self.known[new] = True


_tables: _Tables | None = None


def visual_form(cps: np.ndarray, offs: np.ndarray, key: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form of every row: look-alikes replaced, invisible signs gone, marks ordered and composed,
    any run of blanks one space, none at the ends. Letter case and punctuation stay.

    As a ``key`` every look-alike is replaced, so that equal looks are equal texts. Otherwise only those in words with
    a Latin letter, or with nothing but look-alikes: words of another script stay as they are.
    """
    global _tables
    if _tables is None:
        _tables = _Tables()
    t = _tables
    t.learn(cps)
    sizes = t.size[cps].astype(np.int64)
    out = t.pool[at.ragged_index(t.first[cps].astype(np.int64), sizes)]
    offs = at.offsets(sizes)[offs]
    out = t.alike[out] if key else np.where(_borrowed(out, offs, t), t.alike[out], out)
    out = _ordered(out, offs, t)
    out, offs = _composed(out, offs, t)
    return _single_blanks(out, offs)


def _row_starts(n: int, offs: np.ndarray) -> np.ndarray:
    start = np.zeros(n + 1, bool)
    start[offs] = True
    return start[:n]


def _borrowed(cps: np.ndarray, offs: np.ndarray, t: _Tables) -> np.ndarray:
    """Which look-alikes stand in for a Latin letter, by the other letters of their words."""
    kind = t.kind[cps]
    edge = (kind == 0) | _row_starts(len(cps), offs)
    word = np.cumsum(edge)
    count = int(word[-1]) + 1 if len(word) else 1
    latin, other = (np.bincount(word[kind == k], minlength=count) > 0 for k in (_LATIN, _OTHER))
    return (kind == _FOREIGN) & (latin | ~other)[word]


def _ordered(cps: np.ndarray, offs: np.ndarray, t: _Tables) -> np.ndarray:
    mark = t.mark[cps]
    wrong = (mark[:-1] > mark[1:]) & (mark[1:] > 0)
    if not wrong.any() or not (wrong & ~_row_starts(len(cps), offs)[1:]).any():
        return cps
    run = np.cumsum((mark == 0) | _row_starts(len(cps), offs))
    return cps[np.lexsort((mark, run))]


def _composed(cps: np.ndarray, offs: np.ndarray, t: _Tables) -> tuple[np.ndarray, np.ndarray]:
    while True:
        n = len(cps)
        maybe = np.flatnonzero(t.second[cps])
        maybe = maybe[~_row_starts(n, offs)[maybe]]
        if not len(maybe):
            return cps, offs
        mark = t.mark[cps]
        starter = np.maximum.accumulate(np.where(mark == 0, np.arange(n), -1))
        base = starter[maybe - 1]  # the last starter before; -1 where there is none
        row = np.searchsorted(offs, maybe, "right") - 1
        free = (base >= offs[row]) & ((base == maybe - 1) | ((mark[maybe] > mark[maybe - 1]) & (mark[maybe - 1] > 0)))
        maybe, base = maybe[free], base[free]
        keys = (cps[base].astype(np.int64) << 21) | cps[maybe]
        slot = np.minimum(np.searchsorted(t.pair_keys, keys), len(t.pair_keys) - 1)
        hit = t.pair_keys[slot] == keys
        maybe, base, slot = maybe[hit], base[hit], slot[hit]
        if not len(maybe):
            return cps, offs
        base, first = np.unique(base, return_index=True)  # one mark for each starter, the nearest
        maybe, slot = maybe[first], slot[first]
        used = np.isin(base, maybe)  # a starter that itself joins the one before waits
        base, maybe, slot = base[~used], maybe[~used], slot[~used]
        cps = cps.copy()
        cps[base] = t.pair_made[slot]
        keep = np.ones(n, bool)
        keep[maybe] = False
        t.learn(cps[base])
        t.mark[cps[base]] = 0
        cps, offs = cps[keep], np.concatenate([[0], np.cumsum(keep)])[offs]


def _single_blanks(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    blank = (cps == 0x20) | ((cps >= 0x09) & (cps <= 0x0D))
    if not blank.any():
        return cps, offs
    start = _row_starts(len(cps), offs)
    after_blank = np.zeros(len(cps), bool)
    after_blank[1:] = blank[:-1]
    keep = ~(blank & (after_blank | start))
    ends = offs[1:][np.diff(offs) > 0] - 1  # a row's last sign: if blank, its run's first blank goes as well
    run_start = np.maximum.accumulate(np.where(blank & ~(after_blank & ~start), np.arange(len(cps)), 0))
    keep[run_start[ends[blank[ends]]]] = False
    cps = np.where(blank, np.uint32(0x20), cps)
    return cps[keep], np.concatenate([[0], np.cumsum(keep)])[offs]


def _form_array(arr: pa.Array, key: bool = True) -> pa.Array:
    parts = []
    for a, b in at.slices(arr):
        part = arr.slice(a, b - a)
        parts.append(at.from_codepoints(*visual_form(*at.to_codepoints(part), key), np.asarray(part.is_valid())))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(T.StringType())
def visual_form_of(text: pa.Array) -> pa.Array:
    """The consistent form of a text column, for comparisons; null for null, empty for empty."""
    return _form_array(text)


@F.arrow_udf(T.StringType())
def clean_text_of(text: pa.Array) -> pa.Array:
    """A text column's consistent form to keep: words of other scripts stay; null for null, empty for empty."""
    return _form_array(text, key=False)


def plain_form(text: Column) -> Column:
    """A text without what is no difference in characters: blanks around it, and how many plain blanks stand between words."""
    return F.regexp_replace(core_text.strip(text), "[ \\t\\r\\n]+", " ")


def look_alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """``a_id < b_id``: every pair of rows whose texts look the same but differ in characters.

    Null and blank texts are in no pair; texts that differ only in plain blanks are no pair, nor are exact
    repeats, but each repeat is paired with every row of another spelling. Rows meet by hashes of their form
    and of their spelling: only forms that have two spellings reach the join, spellings are paired first and
    their rows joined to them after that, so that a large group of copies costs what it returns.
    """
    form = visual_form_of(F.col("text"))
    rows = (
        df.select(df[key].alias("id"), df[text].alias("text"))
        .filter(core_text.not_blank(F.col("text")))
        .withColumn("form", form)
        .select("id", F.xxhash64("form").alias("f1"), F.xxhash64(F.lit(1), "form").alias("f2"), F.xxhash64(plain_form(F.col("text"))).alias("s"), F.expr("form <> ''").alias("seen"))
        .filter("seen")
        .drop("seen")
    )
    return _pairs_of_spellings(rows)


def _pairs_of_spellings(rows: DataFrame) -> DataFrame:
    rows = written(rows, "forms")
    spellings = rows.groupBy("f1", "f2", "s").agg(F.count(F.lit(1)).alias("n"))
    form = W.partitionBy("f1", "f2")
    own = spellings.withColumns({"lo": F.min("s").over(form), "hi": F.max("s").over(form)}).filter("lo < hi").select("f1", "f2", "s", "n")
    own = written(own, "spellings")
    left, right = (own.select("f1", "f2", F.col("s").alias(f"s{k}"), F.col("n").alias(f"n{k}")) for k in (1, 2))
    pairs = written(left.join(right, ["f1", "f2"]).filter("s1 < s2"), "spelling-pairs")
    some = sketch.likely(rows, own, "f1")
    first = attach(some.select("f1", "f2", F.col("s").alias("s1"), F.col("id").alias("x")), pairs, ["f1", "f2", "s1"], [], ["s2", "n2"], "n1", spread=["x"])
    found = attach(some.select("f1", "f2", F.col("s").alias("s2"), F.col("id").alias("y")), first, ["f1", "f2", "s2"], [], ["x"], "n2", spread=["y"], sizes=pairs)
    return found.select(F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id"))


def template_variants(df: DataFrame, key: str, text: str, templates: DataFrame, index: str, template: str) -> DataFrame:
    """``a_id`` (the template's index) and ``b_id`` (the row): rows whose whole text looks the same as a template
    but differs from it in characters. Of templates that look the same the smallest index counts. Null and blank texts are none.
    """
    forms = (
        templates.select(templates[index].cast("bigint").alias("a_id"), templates[template].alias("t"))
        .filter(core_text.not_blank(F.col("t")))
        .withColumn("form", visual_form_of("t"))
        .groupBy("form")
        .agg(F.min_by(plain_form(F.col("t")), "a_id").alias("plain"), F.min("a_id").alias("a_id"))
    )
    rows = df.select(df[key].alias("b_id"), df[text].alias("text")).filter(core_text.not_blank(F.col("text"))).withColumn("form", visual_form_of("text"))
    return rows.join(forms, "form").filter(plain_form(F.col("text")) != F.col("plain")).select("a_id", "b_id")
