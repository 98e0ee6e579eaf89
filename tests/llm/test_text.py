"""Code points, visual forms, encodings and counts against plain Python and the public libraries."""

import base64
import os
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from promptloom.llm import arrowtext as at
from promptloom.llm import bpe, budget, encoding, trie, visual

needs_files = pytest.mark.skipif(not os.path.isdir(bpe.TOKENIZER_DIR), reason="no tokenizer files")
ODD = ["", None, "  ", "it's I'll 'the \n\n x  y\n 's 'lla", "<|endoftext|> a　c", "'''s  'S ''re", "x\t\ty  ", "▁▁a ▁ b🙂👩‍🌾", "\x1ca\x85b", "ab'sc'd", "দেওয়া অামার 364", "क़दम ｌｉｎｋ", "x" * 3000, "字漢 ﬁ①½"]
plain_text = st.text(st.characters(blacklist_categories=("Cs",)), max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), plain_text), max_size=8))
def test_code_points_round_trip(texts):
    arr = pa.array(["pad", *texts], pa.string()).slice(1)
    cps, offs = at.to_codepoints(arr)
    assert at.from_codepoints(cps, offs, np.array([t is not None for t in texts], bool)).to_pylist() == texts


def test_bytes_that_are_no_utf8():
    arr = pa.StringArray.from_buffers(2, pa.py_buffer(np.array([0, 2, 4], np.int32).tobytes()), pa.py_buffer(b"a\xff\xc3\xa9"))
    cps, offs = at.to_codepoints(arr)
    assert cps.tolist() == [97, 0xFFFD, 0xE9] and offs.tolist() == [0, 2, 3]


def test_segment_hashes_tell_segments_apart():
    random.seed(0)
    values = np.array([random.randint(0, 3) for _ in range(500)], np.uint32)
    ranges = [(a, a + n) for a in range(0, 480) for n in (0, 1, 3, 8, 20)]
    h = at.segment_hashes(values, np.array([a for a, _ in ranges]), np.array([b for _, b in ranges]))
    seen = {}
    for (a, b), x in zip(ranges, h.tolist()):
        assert seen.setdefault(x, tuple(values[a:b])) == tuple(values[a:b])
    assert len(seen) == len({tuple(values[a:b]) for a, b in ranges})


def forms(texts):
    return visual._form_array(pa.array(texts, pa.string())).to_pylist()


@settings(max_examples=150, deadline=None)
@given(st.text("aeéকোো̧̣́ড়্ক্ষ  \n", max_size=12))
def test_composition_is_nfc(text):
    want = " ".join(unicodedata.normalize("NFC", text).replace(" ", " ").split())
    assert forms([text]) == [want]


def test_look_alikes_become_one():
    assert forms(["prоfіlе", "ｐｒｏｆｉｌｅ", "pro​fi­le", "profile"]) == ["profile"] * 4
    assert forms(["অামি", "আমি", "a b", "a  b ", "３６４", "كيا", None, "", "​"]) == ["আমি", "আমি", "a b", "a b", "364", "کیا", None, "", ""]
    assert forms(["pαypal", "ριzza", "аррӏе", "օk", "Ꮯat", "ⅼist"]) == ["paypal", "pizza", "apple", "ok", "Cat", "list"]
    assert forms([unicodedata.normalize("NFD", "한국어 말"), "한국어 말", "한국어"]) == ["한국어 말", "한국어 말", "한국어"]
    kept = visual._form_array(pa.array(["Сегодня хорошая", "pаypаl аррӏе", "Ceгодня", "αβγ", None, "", "দেওয়া", "x\u200b у"]), key=False).to_pylist()
    assert kept == ["Сегодня хорошая", "paypal apple", "Ceгoдня", "αβγ", None, "", forms(["দেওয়া"])[0], "x y"]
    assert forms(["Сегодня"]) == forms(["Ceгoдня"])
    assert forms(["Profile", "x²"]) == ["Profile", "x²"]
    many = forms(["á" * 500 + " " * 50, "b"])
    assert many == ["á" * 500, "b"]


def test_look_alike_pairs(spark):
    data = [(1, "a profile", 0), (2, "a prоfile", 0), (3, "a profile", 0), (4, " a   profile\n", 0), (5, "A profile", 0), (6, None, 0), (7, "", 0), (8, "​", 0), (9, "a profile", 0), (10, "​ ", 0)]
    df = spark.createDataFrame(data, "record_id long, prompt string, f1 int")
    got = sorted((r.a_id, r.b_id) for r in visual.look_alike_pairs(df, "record_id", "prompt").collect())
    assert got == [(1, 2), (1, 3), (2, 3), (2, 4), (2, 9), (3, 4), (3, 9)]
    assert visual.look_alike_pairs(df.limit(0), "record_id", "prompt").count() == 0
    t = spark.createDataFrame([(4, "a profile"), (2, "a profile"), (3, None)], "template_index int, t string")
    assert sorted(tuple(r) for r in visual.template_variants(df, "record_id", "prompt", t, "template_index", "t").collect()) == [(2, 2), (2, 3)]


@needs_files
@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_byte_vocabularies(name):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(f"{name}.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(1)
    texts = ODD + ["".join(random.choice("ab' \n1'sre়াক।é🙂.") for _ in range(random.randint(0, 60))) for _ in range(400)]
    ids, offs = bpe.load(name).encode(*at.to_codepoints(pa.array(texts, pa.string())))
    assert [ids[a:b].tolist() for a, b in zip(offs, offs[1:])] == [lib.encode_ordinary(t or "") for t in texts]


@needs_files
def test_piece_vocabulary_and_its_counter():
    sentencepiece = pytest.importorskip("sentencepiece")
    lib = sentencepiece.SentencePieceProcessor(model_file=f"{bpe.TOKENIZER_DIR}/piece_bpe_32k.model")
    random.seed(2)
    texts = ODD + ["".join(random.choice("the ing  a।কাে字🙂▁") for _ in range(random.randint(0, 50))) for _ in range(300)]
    cps, offs = at.to_codepoints(pa.array(texts, pa.string()))
    ids, o = bpe.load("piece_bpe_32k").encode(cps, offs)
    want = [lib.encode(t or "") for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(o, o[1:])] == want
    assert trie.load("piece_bpe_32k").count(cps, offs).tolist() == [len(x) for x in want]


@needs_files
def test_unigram_counter_is_the_best_path():
    base = bpe.load("piece_bpe_32k")
    pieces = sorted(p for p in base.pieces if "▁" not in p and len(p) < 5)[:3000]
    random.seed(3)
    score = {p: -random.random() * 10 for p in pieces}

    class Vocabulary:
        size = len(pieces)

    Vocabulary.pieces = {p: i for i, p in enumerate(pieces)}
    counter = trie.TrieCounter(Vocabulary, scores=np.array([score[p] for p in pieces]))
    letters = [p for p in pieces if len(p) == 1]
    words = ["".join(random.choice(letters) for _ in range(random.randint(1, 12))) for _ in range(300)]

    def brute(w):
        best = [(0.0, 0)] + [(-1e18, 0)] * len(w)
        for i in range(len(w)):
            for p in range(1, 5):
                if w[i : i + p] in score and i + p <= len(w):
                    new = best[i][0] + score[w[i : i + p]]
                    if new > best[i + p][0]:
                        best[i + p] = (new, best[i][1] + 1)
        return best[-1][1]

    lens = np.array([len(w) for w in words])
    cps, offs = np.array([ord(c) for w in words for c in w], np.uint32), at.offsets(lens)
    assert np.diff(counter.encode_segments(cps, offs[:-1], offs[1:])[1]).tolist() == [brute(w) for w in words]


@needs_files
def test_encode_and_budget_queries(spark):
    df = spark.createDataFrame([(i, t, "S." if i % 2 else None, "x") for i, t in enumerate(ODD)], "doc_id long, text string, source string, ids string")
    got = {r.doc_id: r.ids for r in encoding.encode(df, "doc_id", "text").collect()}
    assert got[0] == [] and got[1] == [] and len(got) == len(ODD) and 50256 not in got[4]
    assert encoding.encode(df.limit(0), "doc_id", "text").count() == 0
    out = budget.budget(df, "text", {"source": F.col("source"), "lang": F.col("ids")})
    whole = out.filter("source = '(all)' and lang = '(all)'").first()
    counts = trie.load("piece_bpe_32k").count(*at.to_codepoints(pa.array(ODD, pa.string())))
    assert (whole.n_rows, whole.n_texts, whole.n_tokens) == (len(ODD), len(ODD) - 1, int(counts.sum()))
    assert sum(r.n_tokens for r in out.filter("source <> '(all)' and lang <> '(all)'").collect()) == whole.n_tokens
    one = {r.source: (r.n_rows, r.n_tokens) for r in budget.budget(df, "text", {"source": F.col("source")}).collect()}
    assert one["(all)"] == (len(ODD), whole.n_tokens) and sum(n for k, (n, _) in one.items() if k != "(all)") == len(ODD) and set(one) == {"(all)", "S.", "unknown"}
    assert budget.budget(df.limit(0), "text", {"source": F.col("source")}).count() == 0
