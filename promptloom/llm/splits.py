"""Problem 5: records of evaluation splits that occur, exactly or almost, in the training split.

An edit-distance segment join over words. Equal word sequences are one class. An evaluation text of n words
is cut into n//5 + 1 segments: no training text within its bound can differ in all of them, so one segment
stands unchanged there. Each segment holds a window of three words (two in a text of five); the cuts are
placed so that the windows are the rarest that fit side by side. Training texts offer all their windows, so that
rows grow with the words and nothing else. Windows meet in a join that compares position, length and a
signature of the words; windows that many evaluation texts share are dealt to several tasks. Banded dynamic
programming over whole word sequences decides.
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
from promptloom.operators.attach import MOST_HOT, attach
from promptloom.storage import written

#: At most one word of this many may be changed, dropped or added.
WORDS_PER_EDIT = 6
#: Words of a window: any text of six or more words has room for one in each of its segments.
WINDOW = 3
#: Cuts are placed within stretches of so many words, so that a very long text costs no more for each word than others.
STRETCH = 15
#: Slots of the word counts that guide the cuts; they change only how many candidates there are.
COUNT_BITS = 16
#: Evaluation texts of one window that one task pairs with the training texts of that window.
HOT_WINDOW = 2_000


def plain_words(text: Column) -> Column:
    """The words of a text with one space between: letter case, white space and punctuation aside."""
    return F.trim(F.regexp_replace(F.lower(text), rf"[\p{{P}}{core_text.BLANKS[1:-1]}]+", " "))


def words_of(plain: Column) -> Column:
    """The words of a plain text, by their hashes."""
    return F.transform(F.split(plain, " "), lambda w: F.xxhash64(w))


def _window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` words in each row of a matrix."""
    n = words.shape[1] - size + 1
    out = np.full((len(words), n), size, np.uint64)
    for k in range(size):
        out = at.mix(out * np.uint64(0x9E3779B97F4A7C15) + words[:, k : k + n].astype(np.uint64))
    return out


def _signature(words: np.ndarray) -> np.ndarray:
    """Which of SIGNATURE classes the words of each text belong to: an edit changes two bits at most."""
    return np.bitwise_or.reduce(np.int64(1) << (words.view(np.uint64) % np.uint64(SIGNATURE)).astype(np.int64), axis=1)


def _by_length(batch: pa.RecordBatch, ids: str, words: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and word matrices of a batch, texts of one length together, in pieces of bounded size."""
    id_ = batch.column(ids).to_numpy(zero_copy_only=False)
    flat = batch.column(words).flatten().to_numpy(zero_copy_only=False)
    lens = np.diff(batch.column(words).offsets.to_numpy())
    offs = at.offsets(lens)
    for n in np.unique(lens[lens > 0]).tolist():
        rows = np.flatnonzero(lens == n)
        step = max(1, 400_000 // n)
        for k in range(0, len(rows), step):
            own = rows[k : k + step]
            yield id_[own], flat[offs[own][:, None] + np.arange(n)]


#: A window in two numbers, as these rows are the bulk of what is shuffled. ``key``: 44 bits of the window's hash, by which windows meet, and 20 of its
#: text's signature; ``spot``: 12 bits for the number of the text's words, 12 for the window's first place, 8 for the distance to its last, and the
#: other 32 of the signature. A text of FAR or more words, whose places may not fit, is compared by length only.
_KEY = T.StructType([T.StructField("key", T.LongType()), T.StructField("cid", T.LongType()), T.StructField("spot", T.LongType())])
FAR, WIDE, SIGNATURE, IN_KEY = (1 << 12) - 1, (1 << 8) - 1, 52, 20


def _window(key: Column) -> Column:
    return F.shiftrightunsigned(key, IN_KEY)


def _key_batch(key: np.ndarray, row: np.ndarray, at_: np.ndarray, cid: np.ndarray, n: int, sig: np.ndarray) -> pa.RecordBatch:
    """One row for each window of a text, with its first and last place: a text that repeats itself stays small."""
    key = key & ~np.uint64((1 << IN_KEY) - 1)
    order = np.lexsort((at_, key, row))
    key, row, at_ = key[order], row[order], at_[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(first)
    last = np.append(start[1:], len(key)) - 1
    key, row, lo, hi = key[start], row[start], np.minimum(at_[start], FAR), at_[last]
    spot = (np.int64(min(n, FAR)) << 52) | (lo << 40) | (np.minimum(hi - lo, WIDE) << 32) | (sig[row] & ((1 << 32) - 1))
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64) | (sig[row] >> 32)), pa.array(cid[row]), pa.array(spot)], _KEY.names)


def _spot(side: str) -> tuple[Column, Column, Column, Column, Column]:
    """Words, first and last place, and both parts of the signature; the last place is unbounded where it did not fit."""
    spot = F.col(f"{side}.spot")
    lo, wide = F.shiftright(spot, 40).bitwiseAND(F.lit(FAR)), F.shiftright(spot, 32).bitwiseAND(F.lit(WIDE))
    sig = spot.bitwiseAND(F.lit((1 << 32) - 1)), F.col(f"{side}.key").bitwiseAND(F.lit((1 << IN_KEY) - 1))
    return F.shiftrightunsigned(spot, 52), lo, F.when(wide < WIDE, lo + wide).otherwise(1 << 31), *sig


def window_of(n: int) -> int:
    """Words of the windows of an evaluation text of n words."""
    return min(WINDOW, n if n < WORDS_PER_EDIT - 1 else max(2, n // pieces_of(n)))


def pieces_of(n: int) -> int:
    """One more than the edits that a text within the bound of one of n words may need."""
    return n // (WORDS_PER_EDIT - 1) + 1


def cut(cost: np.ndarray, pieces: int, size: int) -> np.ndarray:
    """Starts of ``pieces`` disjoint windows of ``size`` words in each row, of least total cost; ``cost`` is that of each window."""
    rows, places = cost.shape
    far = np.float64(np.inf)
    best = np.zeros((rows, places + size))  # cell j: least cost of the windows so far within the first j words
    took = []
    for _ in range(pieces):
        new = np.full((rows, places + size), far)
        taken = np.zeros((rows, places + size), bool)
        for j in range(size, places + size):
            here = best[:, j - size] + cost[:, j - size]
            taken[:, j] = here < new[:, j - 1]
            new[:, j] = np.where(taken[:, j], here, new[:, j - 1])
        took.append(taken)
        best = new
    out = np.zeros((rows, pieces), np.int64)
    end = np.full(rows, places + size - 1)
    own = np.arange(rows)
    for k in range(pieces - 1, -1, -1):
        while not (hit := took[k][own, end]).all():
            end = np.where(hit, end, end - 1)
        end = end - size
        out[:, k] = end
    return out


def cuts(cost: np.ndarray, n: int, size: int) -> np.ndarray:
    """Starts of the windows of texts of n words, stretch by stretch: the last takes what is left, with the odd piece."""
    if n < 2 * STRETCH:
        return cut(cost, pieces_of(n), size)
    last = (n // STRETCH - 1) * STRETCH
    body = np.stack([cost[:, k : k + STRETCH - size + 1] for k in range(0, last, STRETCH)], axis=1)
    rows, stretches, width = body.shape
    each = STRETCH // (WORDS_PER_EDIT - 1)
    starts = cut(body.reshape(-1, width), each, size).reshape(rows, stretches, each) + (np.arange(stretches) * STRETCH)[None, :, None]
    return np.concatenate([starts.reshape(rows, -1), cut(cost[:, last:], pieces_of(n) - each * stretches, size) + last], axis=1)


def _index(counts: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, words in _by_length(batch, "cid", "w"):
                n = words.shape[1]
                if n < WORDS_PER_EDIT - 1:  # no edit is allowed: such a text has its equals in its class
                    continue
                size = window_of(n)
                rare = counts[words.view(np.uint64) >> np.uint64(64 - COUNT_BITS)]
                # a window is no more frequent than its rarest word
                cost = np.minimum.reduce([rare[:, k : n - size + 1 + k] for k in range(size)]).astype(np.float64)
                start = cuts(cost, n, size)
                key = np.take_along_axis(_window_hashes(words, size), start, axis=1)
                yield _key_batch(key.ravel(), np.repeat(np.arange(len(cid)), start.shape[1]), start.ravel(), cid, n, _signature(words))

    return run


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cid, words in _by_length(batch, "cid", "w"):
            n, sig = words.shape[1], _signature(words)
            if n < WORDS_PER_EDIT - 1:
                continue
            most = n // WORDS_PER_EDIT
            for size in sorted({window_of(m) for m in range(max(WORDS_PER_EDIT - 1, n - most), min(n * WORDS_PER_EDIT // (WORDS_PER_EDIT - 1), n + n) + 1)}):
                if size <= n:
                    key = _window_hashes(words, size)
                    row, start = np.divmod(np.arange(key.size), key.shape[1])
                    yield _key_batch(key.ravel(), row, start, cid, n, sig)


def within(a: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_len: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair of rows is at most its bound: dynamic programming over a band.

    ``a`` and ``b`` are matrices, filled up with anything beyond the lengths; ``most`` has the bounds.
    """
    width = int(most.max(initial=0))
    far = np.int32(1 << 20)
    result = np.where(a_len == 0, b_len, far).astype(np.int32)
    row = np.flatnonzero(a_len > 0)  # rows still open; closed ones leave the arrays
    a, a_len, b_len, bound = a[row], a_len[row], b_len[row], most[row]
    shift = np.arange(2 * width + 1) - width
    steps = np.arange(2 * width + 1, dtype=np.int32)
    band = np.full((len(row), 2 * width + 1), far, np.int32)  # cell k of row i: distance to b[: i + k - width]
    band[:, width:] = np.arange(width + 1, dtype=np.int32)
    band[shift[None, :] > b_len[:, None]] = far
    b_wide = np.concatenate([b[row], np.zeros((len(row), 2 * width + 1), b.dtype)], axis=1)
    i = 0
    while len(row):
        i += 1
        j = i + shift
        inside = (j[None, :] >= 1) & (j[None, :] <= b_len[:, None])
        other = b_wide[:, np.clip(j - 1, 0, b_wide.shape[1] - 1)]
        new = band + (other != a[:, i - 1 : i])  # one changed, or none
        new[:, :-1] = np.minimum(new[:, :-1], band[:, 1:] + 1)  # one of a dropped
        new[:, j == 0] = i
        new = np.where(inside | (j[None, :] == 0), new, far)
        new = np.minimum.accumulate(new - steps, axis=1) + steps  # one of b added
        band = np.minimum(np.where(inside | (j[None, :] == 0), new, far), far)
        done = np.flatnonzero(a_len == i)
        if len(done):
            k = b_len[done] - i + width
            ok = (k >= 0) & (k <= 2 * width)
            result[row[done[ok]]] = band[done[ok], k[ok]]
        closed = (a_len == i) | (band.min(axis=1) > bound)  # once the whole band is beyond the bound it stays there
        if closed.sum() * 4 > len(row) or closed.all():
            keep = ~closed
            row, a, a_len, b_len, bound, band, b_wide = row[keep], a[keep], a_len[keep], b_len[keep], bound[keep], band[keep], b_wide[keep]
        elif len(done):  # too few to be worth a copy: they run on, and change nothing
            a_len = np.where(a_len == i, -1, a_len)
        if i >= a.shape[1]:
            break
    return result <= most


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [(batch.column(c).flatten().to_numpy(zero_copy_only=False), np.diff(batch.column(c).offsets.to_numpy())) for c in ("w_e", "w_t")]
        offs = [at.offsets(lens) for _, lens in lists]
        longest = np.maximum(lists[0][1], lists[1][1])
        keep = np.zeros(batch.num_rows, bool)
        order = np.argsort(-longest, kind="stable")  # the longest of a piece decides its size
        k = 0
        while k < len(order):
            size = max(1, 200_000 // max(1, int(longest[order[k]])))
            own = order[k : k + size]
            width = int(longest[own].max())
            mats = []
            for (flat, lens), o in zip(lists, offs):
                m = np.zeros((len(own), width), np.int64)
                m[np.arange(width)[None, :] < lens[own][:, None]] = flat[at.ragged_index(o[own], lens[own])]
                mats.append(m)
            keep[own] = within(mats[0], lists[0][1][own], mats[1], lists[1][1][own], longest[own] // WORDS_PER_EDIT)
            k += size
        yield pa.RecordBatch.from_arrays([batch.column("e").filter(pa.array(keep)), batch.column("t").filter(pa.array(keep))], ["e", "t"])


def _plain(df: DataFrame, key: str, text: str, split: str, train: str, evaluation: tuple[str, ...], extra: tuple[str, ...]) -> DataFrame:
    part = F.lower(core_text.strip(df[split]))
    rows = df.select(df[key].alias("id"), df[text].alias("text"), part.alias("part"), *(df[c].alias(f"x_{c}") for c in extra))
    rows = rows.filter(F.col("part").isin(train, *evaluation) & core_text.not_blank(F.col("text")))
    return rows.withColumn("plain", plain_words(F.col("text"))).filter("plain <> ''")


def _rows(df: DataFrame, key: str, text: str, split: str, train: str, evaluation: tuple[str, ...], extra: tuple[str, ...] = ()) -> DataFrame:
    rows = _plain(df, key, text, split, train, evaluation, extra)
    # 16 bytes name a word sequence
    rows = rows.withColumns({"c": F.unhex(F.md5("plain")), "in_train": F.col("part") == train, "w": words_of(F.col("plain"))})
    return written(rows.drop("text", "plain"), "split-rows")


def evaluation_rows(df: DataFrame, key: str, text: str, split: str, source: str, train: str = "train", evaluation: tuple[str, ...] = ("validation", "test")) -> DataFrame:
    """``split, source, n_rows``: the evaluation rows that the search is about."""
    rows = _plain(df, key, text, split, train, evaluation, (source,)).filter(F.col("part") != train)
    return rows.groupBy(F.col("part").alias("split"), core_text.clean_name(F.col(f"x_{source}")).alias("source")).agg(F.count(F.lit(1)).alias("n_rows"))


def _candidates(index: DataFrame, probes: DataFrame) -> DataFrame:
    """``e_id, t_id`` of texts with a window at like places. The evaluation texts of a frequent window are dealt to several parts, and
    its training texts go to each."""
    (e_n, e_lo, e_hi, *e_sig), (t_n, t_lo, t_hi, *t_sig) = _spot("e"), _spot("t")
    longer = F.greatest(e_n, t_n)
    most = F.floor(longer / WORDS_PER_EDIT)
    places = (t_lo - e_hi <= most) & (e_lo - t_hi <= most) & (F.bit_count(e_sig[0].bitwiseXOR(t_sig[0])) + F.bit_count(e_sig[1].bitwiseXOR(t_sig[1])) <= 2 * most)
    near = (F.abs(e_n - t_n) <= most) & (places | (longer == FAR))
    per_key = index.groupBy(_window(F.col("key")).alias("h")).agg(F.count(F.lit(1)).alias("rows"))
    known = per_key.agg(F.sum("rows").alias("total"), F.max("rows").alias("top")).first()
    limit = max(HOT_WINDOW, (known.total or 0) // MOST_HOT)
    if (known.top or 0) > limit:
        hot = F.broadcast(per_key.filter(F.col("rows") > limit).select("h", F.ceil(F.col("rows") / limit).cast("int").alias("parts")))  # at most MOST_HOT rows
        index = index.join(hot, _window(F.col("key")) == F.col("h"), "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("cid"), F.col("parts")), F.lit(0)).cast("int")).drop("h", "parts")
        probes = probes.join(hot, _window(F.col("key")) == F.col("h"), "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("h", "parts")
        part = F.col("e.part") == F.col("t.part")
    else:
        part = F.lit(True)
    e, t = index.alias("e"), probes.alias("t")
    return e.join(t, (_window(F.col("e.key")) == _window(F.col("t.key"))) & part & (F.col("e.cid") != F.col("t.cid")) & near).select(F.col("e.cid").alias("e_id"), F.col("t.cid").alias("t_id")).distinct()


def class_pairs(rows: DataFrame) -> DataFrame:
    """``c_e, c_t, n_e, n_t``: the classes of evaluation and training texts that are equal or almost equal, and their numbers of rows. ``rows`` has
    ``id, c, w, in_train``."""
    classes = rows.groupBy("c", "w").agg(F.min("id").alias("cid"), F.count_if("in_train").alias("n_t"), F.count_if(~F.col("in_train")).alias("n_e"))
    classes = written(classes, "classes")
    index = written(classes.filter("n_e > 0").select("cid", "w").mapInArrow(_index(_word_counts(classes)), _KEY), "segments")
    candidates = _candidates(index, classes.filter("n_t > 0").select("cid", "w").mapInArrow(_probe, _KEY))
    left = classes.filter("n_e > 0").select(F.col("cid").alias("e_id"), F.struct("c", "n_e").alias("e"), F.col("w").alias("w_e"))
    right = classes.filter("n_t > 0").select(F.col("cid").alias("t_id"), F.struct("c", "n_t").alias("t"), F.col("w").alias("w_t"))
    both = candidates.join(left, "e_id").join(right, "t_id").select("e", "t", "w_e", "w_t")
    almost = both.mapInArrow(_verify, both.select("e", "t").schema).select(F.col("e.c").alias("c_e"), F.col("t.c").alias("c_t"), "e.n_e", "t.n_t")
    same = classes.filter("n_e > 0 and n_t > 0").select(F.col("c").alias("c_e"), F.col("c").alias("c_t"), "n_e", "n_t")
    return written(same.unionByName(almost), "class-pairs")


def _word_counts(classes: DataFrame) -> np.ndarray:
    """Words of all classes, counted in a fixed number of slots."""
    slot = F.shiftrightunsigned(F.col("x"), 64 - COUNT_BITS)
    got = classes.select(F.explode("w").alias("x")).groupBy(slot.alias("s")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    out = np.zeros(1 << COUNT_BITS, np.int64)
    out[got["s"].to_numpy()] = got["n"].to_numpy()
    return out


def overlaps(df: DataFrame, key: str, text: str, split: str, train: str = "train", evaluation: tuple[str, ...] = ("validation", "test")) -> DataFrame:
    """``a_id < b_id``: every pair of one training and one evaluation row whose texts are equal or almost equal.

    Letter case, white space and punctuation aside, at most one word in six of the longer text is changed,
    dropped or added. Rows with a null, blank or wordless text or with a null or other split are in no pair.
    Repeated rows each count. Pairs are found between distinct texts and expanded to rows at the end.
    """
    rows = _rows(df, key, text, split, train, evaluation)
    pairs = class_pairs(rows)
    t = rows.filter("in_train").select(F.col("id").alias("t_id"), F.col("c").alias("c_t"))
    e = rows.filter("not in_train").select(F.col("id").alias("e_id"), F.col("c").alias("c_e"))
    first = attach(t, pairs, ["c_t"], [], ["c_e", "n_e"], "n_t", spread=["t_id"])
    found = attach(e, first, ["c_e"], [], ["t_id"], "n_e", spread=["e_id"], sizes=pairs)
    return found.select(F.least("t_id", "e_id").alias("a_id"), F.greatest("t_id", "e_id").alias("b_id"))


def report(df: DataFrame, key: str, text: str, split: str, source: str, label: str, train: str = "train", evaluation: tuple[str, ...] = ("validation", "test")) -> DataFrame:
    """For each evaluation split and normalised source: rows, rows with an equal or almost equal training row, pairs, and
    pairs whose labels differ (first word of the label, letter case aside; null labels never differ).

    Counted by classes, so that no pair of rows is made. A null source is its own group.
    """
    kind = F.lower(F.regexp_extract(core_text.strip(df[label]), r"^(\p{L}+)", 1))
    rows = _rows(df.withColumn("_label", F.when(kind != "", kind)), key, text, split, train, evaluation, (source, "_label"))
    pairs = class_pairs(rows).select("c_e", "c_t")
    rows = rows.select("id", "c", "in_train", "part", core_text.clean_name(F.col(f"x_{source}")).alias("source"), F.col("x__label").alias("label"))
    train_labels = rows.filter("in_train").groupBy(F.col("c").alias("c_t"), F.col("label").alias("t_label")).agg(F.count(F.lit(1)).alias("n"))
    by_class = pairs.join(train_labels, "c_t").groupBy("c_e", "t_label").agg(F.sum("n").alias("n"))
    by_class = by_class.groupBy("c_e").agg(F.sum("n").alias("pairs"), F.map_from_entries(F.collect_list(F.when(F.col("t_label").isNotNull(), F.struct("t_label", "n")))).alias("of"), F.sum(F.when(F.col("t_label").isNotNull(), F.col("n"))).alias("labelled"))
    groups = rows.filter("not in_train").groupBy("c", F.col("part").alias("split"), "source", "label").agg(F.count(F.lit(1)).alias("rows"))
    met = groups.join(by_class, groups["c"] == by_class["c_e"], "left")
    differ = F.when(F.col("label").isNotNull(), F.coalesce("labelled", F.lit(0)) - F.coalesce(F.try_element_at("of", F.col("label")), F.lit(0))).otherwise(0)
    return met.groupBy("split", "source").agg(
        F.sum("rows").alias("n_rows"),
        F.sum(F.when(F.col("pairs").isNotNull(), F.col("rows")).otherwise(0)).alias("n_overlapping"),
        F.sum(F.coalesce(F.col("pairs") * F.col("rows"), F.lit(0))).alias("n_pairs"),
        F.sum(differ * F.col("rows")).alias("n_label_differs"),
    )
