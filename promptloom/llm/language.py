"""Problem 6: a language with a confidence for each text and for each segment of a mixed one.

Multinomial naive Bayes over hashed character n-grams of words. The matrix of log probabilities goes to the
workers; each batch scores its distinct words by array look-ups. Within a text the words' scores run through
a best-path search with a price on each change of language, which gives its segments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.functions import text as core_text
from promptloom.llm import arrowtext as at
from promptloom.llm.visual import visual_form

#: Hashed n-grams are spread over this many rows of the matrix (1.5 MB for six languages, whatever the corpus).
BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
#: A word's n-grams overlap and are far from independent: what they say together counts by this share.
SHARE = 1 / 6
#: The most that one word can say for or against a language, and the price of a change, in nats: a run in mid-text pays
#: two changes, so that two clear words never suffice and four need not be quite clear.
WORD_LIMIT, CHANGE = 6.0, 6.0
#: Words that a run must have to make its language one of the text's.
MIN_RUN = 4
#: About so many labelled rows of each table and language are drawn to fit the model, besides the certain samples. Equal numbers keep a rare language's words as likely as those of a common one.
FIT_ROWS = 2_000
#: What a row's own label says for its language, in nats, where the text leaves the choice open: most labels are right.
#: Open is a text whose words alone, without the languages' shares, speak against the label by less than the margin.
LABEL_WORTH, LABEL_MARGIN = 3.0, 3.0
_SMOOTH = 0.3


class _Word:
    """Letters and marks, by rule, filled as code points come: 1 no, 2 yes."""

    table = np.zeros(at.MAX_CP, np.uint8)

    @classmethod
    def of(cls, cps: np.ndarray) -> np.ndarray:
        import unicodedata

        out = cls.table[cps]
        if len(out) and not out.all():
            for cp in np.unique(cps[out == 0]).tolist():
                cls.table[cp] = 2 if unicodedata.category(chr(cp))[0] in "LM" else 1
            out = cls.table[cps]
        return out == 2


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points in their consistent form and lower case, starts and ends of words, and each text's first word's number."""
    cps, offs = visual_form(*at.to_codepoints(texts))
    cps = np.where((cps >= 0x41) & (cps <= 0x5A), cps + 32, cps).astype(np.uint32)
    inside = _Word.of(cps)
    edge = np.zeros(len(cps) + 1, bool)
    edge[offs] = True
    before, after = np.concatenate([[False], inside]), np.append(inside, False)
    starts, ends = np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))
    return cps, starts, ends, np.searchsorted(starts, offs)


def _features(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, a sign at each word's ends, and the offsets by word."""
    lens = ends - starts
    offs = at.offsets(lens + 2)
    flat = np.full(int(offs[-1]), 1, np.uint64)
    flat[at.ragged_index(offs[:-1] + 1, lens)] = cps[at.ragged_index(starts, lens)]
    word = np.repeat(np.arange(len(lens)), lens + 2)
    parts, owners = [], []
    h = np.zeros(len(flat), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = at.mix(h[: len(flat) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + flat[n - 1 :])
        if n in ORDERS:
            whole = word[: len(h)] == word[n - 1 :]
            parts.append((h[whole] >> np.uint64(48)).astype(np.int64) % BUCKETS)
            owners.append(word[: len(h)][whole])
    bucket, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return bucket[order], at.offsets(np.bincount(owner, minlength=len(lens)))


class Model:
    """Log probabilities [bucket, language], the languages' codes and their log shares."""

    def __init__(self, codes: list[str], matrix: np.ndarray, prior: np.ndarray):
        self.codes, self.matrix, self.prior = codes, matrix, prior.astype(np.float32)

    @staticmethod
    def counts(texts: pa.Array, own: np.ndarray, languages: int) -> np.ndarray:
        """How often each bucket [bucket x language, flat] occurs in texts of the given languages' numbers."""
        out = np.zeros(BUCKETS * languages, np.int64)
        for a, b in at.slices(texts):
            cps, starts, ends, rows = words_of(texts.slice(a, b - a))
            bucket, offs = _features(cps, starts, ends)
            language = np.repeat(np.repeat(own[a:b], np.diff(rows)), np.diff(offs))
            out += np.bincount(bucket * languages + language, minlength=len(out))
        return out

    @staticmethod
    def of_counts(counts: np.ndarray, codes: list[str], sizes: dict[str, int] | None = None) -> Model:
        """``sizes``: how many rows each language has; equal shares without."""
        table = counts.reshape(BUCKETS, len(codes)) + _SMOOTH
        share = np.array([(sizes or {}).get(c, 0) for c in codes], np.float64) + (1 if not sizes else sum(sizes.values()) / 1000)
        return Model(codes, np.log(table / table.sum(axis=0)).astype(np.float32), np.log(share / share.max()))

    @staticmethod
    def fit(texts: list[str], labels: list[str], codes: list[str], sizes: dict[str, int] | None = None) -> Model:
        number = {c: k for k, c in enumerate(codes)}
        return Model.of_counts(Model.counts(pa.array(texts, pa.string()), np.array([number[x] for x in labels], np.int64), len(codes)), codes, sizes)

    def word_scores(self, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each word's score by language, 0 for the best and not below -WORD_LIMIT."""
        if not len(starts):
            return np.zeros((0, len(self.codes)), np.float32)
        _, first, inverse = np.unique(at.segment_hashes(cps, starts, ends), return_index=True, return_inverse=True)
        bucket, offs = _features(cps, starts[first], ends[first])
        score = np.add.reduceat(self.matrix[bucket], offs[:-1], axis=0)
        score = (score - score.max(axis=1, keepdims=True)) * SHARE
        return np.maximum(score, -WORD_LIMIT).astype(np.float32)[inverse]


def best_paths(scores: np.ndarray, rows: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """The language of each word: the best path of each text, all texts at once, longest first.

    The share of a language counts once, where the text begins, so that a change to a rare one costs no more than another.
    """
    lens = np.diff(rows)
    order = np.argsort(-lens, kind="stable")
    starts, lens = rows[:-1][order], lens[order]
    states = scores.shape[1]
    out = np.zeros(len(scores), np.int64)
    if not len(scores):
        return out
    longest = int(lens[0])
    active = np.searchsorted(-lens, -np.arange(longest), "left")  # texts with more words than i
    back = np.zeros((len(scores), states), np.int8)
    total = scores[starts[: active[0]]] + prior if active[0] else np.zeros((0, states), np.float32)
    for i in range(1, longest):
        n = int(active[i])
        stay = total[:n]
        top = stay.argmax(axis=1)
        change = (stay[np.arange(n), top] - CHANGE)[:, None]
        moved = change > stay
        back[starts[:n] + i] = np.where(moved, top[:, None], np.arange(states)[None, :])
        total[:n] = np.where(moved, change, stay) + scores[starts[:n] + i]
    state = total.argmax(axis=1) if len(total) else np.zeros(0, np.int64)
    for i in range(longest - 1, -1, -1):
        n = int(active[i])
        out[starts[:n] + i] = state[:n]
        if i:
            state[:n] = back[starts[:n] + i, state[:n]]
    return out


def _segments(path: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes (in words) of each text's segments, after those of under MIN_RUN words have gone to a neighbour.

    The shortest goes first, to its longer neighbour; a text without a long run keeps its longest segment.
    """
    n = len(path)
    start = np.ones(n, bool)
    start[1:] = path[1:] != path[:-1]
    start[rows[:-1][np.diff(rows) > 0]] = True
    first = np.flatnonzero(start)
    size = np.diff(np.append(first, n))
    text = np.searchsorted(rows, first, "right") - 1
    count = np.bincount(text, minlength=len(rows) - 1)
    odd = np.unique(text[(size < MIN_RUN) & (count[text] > 1)])
    keep = np.ones(len(first), bool)
    bound = np.searchsorted(text, np.arange(len(rows)))
    for t in odd.tolist():
        own = list(range(bound[t], bound[t + 1]))
        sizes, langs = size[own].tolist(), path[first[own]].tolist()
        while len(own) > 1 and min(sizes) < MIN_RUN:
            k = sizes.index(min(sizes))
            to = k - 1 if k and (k == len(own) - 1 or sizes[k - 1] >= sizes[k + 1]) else k + 1
            lo, hi = min(k, to), max(k, to)
            langs[lo] = langs[to]
            sizes[lo] += sizes[hi]
            del own[hi], sizes[hi], langs[hi]
            lo_ = max(0, lo - 1)
            while lo_ < len(own) - 1 and lo_ <= lo:
                if langs[lo_] == langs[lo_ + 1]:
                    sizes[lo_] += sizes[lo_ + 1]
                    del own[lo_ + 1], sizes[lo_ + 1], langs[lo_ + 1]
                else:
                    lo_ += 1
        keep[bound[t] : bound[t + 1]] = False
        keep[own] = True
        for o, s, g in zip(own, sizes, langs):
            size[o] = s
            path[first[o]] = g
    return first[keep], size[keep]


_SEGMENT = T.StructType(
    [T.StructField("rec_id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("segment", T.IntegerType()), T.StructField("n_segments", T.IntegerType())]
    + [T.StructField("n_words", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType())]
)


def _identify(model: Model, only_wrong: bool = False) -> Callable:
    """``only_wrong``: of each text that is mixed or whose label is missing or wrong, one row for each of its languages."""
    number = {c: k for k, c in enumerate(model.codes)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in at.slices(batch.column("text")):
                part = batch.slice(a, b - a)
                cps, starts, ends, rows = words_of(part.column("text"))
                scores = model.word_scores(cps, starts, ends)
                path = best_paths(scores, rows, model.prior)
                first, size = _segments(path, rows)
                lang = path[first]
                text = np.searchsorted(rows, first, "right") - 1
                count = np.bincount(text, minlength=len(rows) - 1)
                label = np.array([number.get(x, -1) for x in part.column("label").to_pylist()], np.int64)[text]
                run_sums = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores, axis=0, dtype=np.float64)])
                own = run_sums[first + size] - run_sums[first]
                total = own + model.prior
                alone = count[text] == 1
                known = np.flatnonzero(alone & (label >= 0))
                known = known[own[known].max(axis=1, initial=-np.inf) - own[known, label[known]] < LABEL_MARGIN]
                total[known, label[known]] += LABEL_WORTH
                lang[alone] = total[alone].argmax(axis=1)
                # what decides is what the confidence says: words, shares and the label together
                prob = np.exp(total - total.max(axis=1, keepdims=True, initial=-np.inf))
                confidence = np.maximum(prob[np.arange(len(first)), lang] / prob.sum(axis=1), 1e-6)
                position = np.arange(len(first)) - np.searchsorted(text, text)
                if only_wrong:
                    wrong = np.flatnonzero((count[text] > 1) | (label != lang))
                    _, once = np.unique(text[wrong] * len(model.codes) + lang[wrong], return_index=True)
                    own = wrong[once]
                    yield pa.RecordBatch.from_arrays([part.column("rec_id").take(pa.array(text[own])), pa.array(model.codes, pa.string()).take(pa.array(lang[own]))], ["rec_id", "lang"])
                    continue
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("rec_id").take(pa.array(text)),
                        part.column("label").take(pa.array(text)),
                        pa.array(position.astype(np.int32)),
                        pa.array(count[text].astype(np.int32)),
                        pa.array(size.astype(np.int32)),
                        pa.array(model.codes, pa.string()).take(pa.array(lang)),
                        pa.array(np.round(confidence, 6)),
                    ],
                    _SEGMENT.names,
                )

    return run


def code_of(lang: Column, codes: list[str]) -> Column:
    """The code that a label means, whatever its letter case or region; null for a blank label or one that names no language."""
    plain = F.regexp_replace(F.lower(core_text.strip(lang)), "_", "-")
    out = F.lit(None).cast("string")
    for code in sorted(codes, key=len):  # longer codes are tested first
        out = F.when(plain.rlike(f"^{code.lower()}(-|$)"), F.lit(code)).otherwise(out)
    return out


def without_fields(text: Column) -> Column:
    """A JSON object's text without its field names, however long its strings and however many escapes they hold.

    Possessive, so that nothing recurses; no match starts at an escaped quote, so that each string is passed over once.
    """
    return F.when(text.rlike(r"\A\s*\{"), F.regexp_replace(text, r'(?<!\\)"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*:', " ")).otherwise(text)


def fit(samples: DataFrame, lang: str, text: str, labelled: list[tuple[DataFrame, str, str, str]], fit_rows: int = FIT_ROWS) -> Model:
    """A model of the certain ``samples`` (a small table), and then of those and labelled rows that a first model agrees with.

    ``labelled`` has tables with the names of their key, text and label; of each and each language about ``fit_rows`` rows are
    drawn, by the hash of the key, so that the draw does not depend on how the table is stored. Labels may be wrong:
    rows whose text the first model puts elsewhere, or calls mixed, are left out. Texts stay in the tasks that read them; only
    counts are collected, at most BUCKETS for each language.
    """
    rows = [r for r in samples.select(samples[lang].alias("lang"), samples[text].alias("text")).collect() if r.lang and r.text]
    codes = sorted({r.lang for r in rows})
    number = {c: k for k, c in enumerate(codes)}
    counts = Model.counts(pa.array([r.text for r in rows], pa.string()), np.array([number[r.lang] for r in rows], np.int64), len(codes))
    first = Model.of_counts(counts, codes)
    rows_of: dict[str, int] = {}
    drawn = None
    for df, key, text_, lang_ in labelled:
        code = code_of(df[lang_], codes)
        own = {r.lang: r.n for r in df.filter(df[text_].isNotNull()).groupBy(code.alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect() if r.lang is not None}
        rows_of |= {k: rows_of.get(k, 0) + n for k, n in own.items()}
        if not own:
            continue
        below = F.create_map(*(F.lit(x) for k, n in own.items() for x in (k, int(min(1.0, fit_rows / n) * 2**32))))
        # rows are drawn before their texts are looked at
        part = df.withColumn("_lang", code).filter(F.shiftrightunsigned(F.xxhash64(df[key]), 32) < F.try_element_at(below, F.col("_lang")))
        part = part.select(F.col("_lang").alias("label"), without_fields(part[text_]).alias("text")).filter(core_text.not_blank(F.col("text")))
        drawn = part if drawn is None else drawn.unionByName(part)
    if drawn is None:
        return first
    got = drawn.mapInArrow(_agreeing_counts(first), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    if got.num_rows:
        counts[got["slot"].to_numpy()] += got["n"].to_numpy()
    return Model.of_counts(counts, codes, rows_of)


def _agreeing_counts(model: Model) -> Callable:
    """Buckets of the drawn texts that are of one language for the model, and that the one of their label; added up in each task."""
    number = {c: k for k, c in enumerate(model.codes)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * len(model.codes), np.int64)
        for batch in batches:
            label, text = batch.column(0), batch.column(1)
            whole = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), pa.nulls(batch.num_rows, pa.string()), text], ["rec_id", "label", "text"])
            said = np.full(batch.num_rows, -1)
            for found in _identify(model)(iter([whole])):
                alone = found.column("n_segments").to_numpy() == 1
                said[found.column("rec_id").to_numpy()[alone]] = np.array([number[x] for x in found.column("lang").to_pylist()], np.int64)[alone]
            own = np.array([number[x] for x in label.to_pylist()], np.int64)
            same = np.flatnonzero(said == own)
            if len(same):
                total += Model.counts(text.take(pa.array(same)), own[same], len(model.codes))
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], ["slot", "n"])

    return run


def identify(df: DataFrame, key: str, text: str, lang: str, model: Model) -> DataFrame:
    """``rec_id, label, segment, n_segments, n_words, lang, confidence``: one row for each text, or for each segment of a mixed one.

    ``label`` is the code that the row's label means, or null; it decides only where the text leaves the choice open. ``confidence`` is the language's
    posterior probability, by the segment's words, the languages' shares and, where it counts, the label. Null, blank and wordless texts (digits, punctuation) have no row. Field names of JSON texts
    don't count. There is no shuffle.
    """
    rows = df.select(df[key].cast("bigint").alias("rec_id"), code_of(df[lang], model.codes).alias("label"), without_fields(df[text]).alias("text"))
    return rows.filter(core_text.not_blank(F.col("text"))).mapInArrow(_identify(model), _SEGMENT)


def mislabelled(df: DataFrame, key: str, text: str, lang: str, model: Model) -> DataFrame:
    """``rec_id, lang`` of texts whose label is missing or wrong, and of all mixed texts, once for each language of a run of four words.

    Null, blank and wordless texts are none. There is no shuffle.
    """
    rows = df.select(df[key].cast("bigint").alias("rec_id"), code_of(df[lang], model.codes).alias("label"), without_fields(df[text]).alias("text"))
    schema = T.StructType([T.StructField("rec_id", T.LongType()), T.StructField("lang", T.StringType())])
    return rows.filter(core_text.not_blank(F.col("text"))).mapInArrow(_identify(model, only_wrong=True), schema)
