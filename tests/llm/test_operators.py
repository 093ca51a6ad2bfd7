"""Operators against brute force and on odd inputs: nulls, empty and long texts, ties, repeats, clashing columns."""

import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.llm import mixing, packing, templates, tokencount
from vellum.llm.jaccard import jaccard_components
from vellum.llm.langid import BUCKETS, LanguageCode, codewords, grams, identify
from vellum.llm.packing import OpenBins, cut, encode, pack_documents
from vellum.llm.passages import remove_spans, repeated_spans
from vellum.llm.permindex import nearest_neighbours
from vellum.llm.quality import FactorisationMachine, score_quality
from vellum.llm.templates import drop_templates
from vellum.llm.tokencount import count_spliced, count_tokens, counter
from vellum.llm._words import word_hashes
from vellum.llm.vafile import exact_top_k

BYTE_BPE = str(public_tokenizers.path("byte_bpe_50k.json"))
WORD_BPE = str(public_tokenizers.path("word_bpe_49k.json"))
WORDS = [a + b for a in "ka lo mi nu ra te vi zo".split() for b in "n r s t l m".split()]

#: Columns whose names operators use inside.
CLASH = "doc_id long, text string, cls long, n long, key long, digest string, token string, line string, doc long, start long, label string"


def frame(spark, texts):
    rows = [(i, t, 1, 2, 3, "d", "t", "l", 4, 5, "x") for i, t in texts]
    return spark.createDataFrame(rows, CLASH)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def odd_texts():
    rng = random.Random(3)
    base, long = prose(rng, 120), prose(rng, 9000)
    near = base.split()
    near[60] = "changed"
    return [(1, base), (2, " ".join(near)), (3, base), (3, base), (4, None), (5, ""), (6, " \n\t "), (7, "uno dos"), (8, "uno  DOS"), (9, long), (10, "ñandú 日本 <|endoftext|> x"), (None, "sin id")]


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


def brute_components(texts, k, num, den):
    sets = [shingles(t, k) for _, t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), low.get(find(i))) for i, (d, _) in enumerate(texts)), key=str)


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_jaccard_matches_brute_force(spark, k, num):
    rng = random.Random(k)
    texts = odd_texts()
    for g in range(80):  # groups of near copies of every size and distance
        base = prose(rng, rng.choice([4, 9, 10, 11, 15, 20, 30, 40, 60, 65, 150])).split()
        for m in range(rng.choice([2, 3, 8])):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append((100 * (g + 1) + m, " ".join(copy)))
    got = jaccard_components(frame(spark, texts), k=k, num=num, den=100).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(texts, k, num, 100)


@pytest.mark.parametrize("num", [80, 45])
def test_sets_of_frequent_shingles(spark, num):
    rng, texts = random.Random(num), []
    for i in range(240):  # few words, so that every bucket holds sets that do not link
        words = rng.sample(WORDS, rng.choice([1, 2, 3, 12, 19, 20, 21]))
        for m in range(rng.choice([1, 1, 3])):
            copy = [*words]
            for _ in range(rng.randrange(1 + len(words) // 9)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append((10 * i + m, " ".join(copy)))
    got = jaccard_components(frame(spark, texts), k=1, num=num, den=100, count_links=False).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(texts, 1, num, 100)


@pytest.mark.parametrize("block,least", [(1024, 64), (7, 64), (2, 5), (1, 1)])
def test_every_link_of_a_group_is_counted(spark, monkeypatch, block, least):
    monkeypatch.setattr("vellum.llm.jaccard.LINK_BLOCK", block)
    monkeypatch.setattr("vellum.llm.jaccard.LINK_LEAST", least)
    rng, texts = random.Random(8), []
    for g, (n, members) in enumerate([(90, 40), (30, 12), (60, 2), (40, 1)]):
        base = prose(rng, n).split()
        for m in range(members):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = f"x{m}"
            texts.append((100 * g + m, " ".join(copy)))
    sets = {frozenset(shingles(t, 3)) for _, t in texts}
    want = {d: sum(len(s & o) * 100 >= 90 * len(s | o) for o in sets if o != s) for d, t in texts for s in [shingles(t, 3)]}
    got = {r.doc_id: r.n_links for r in jaccard_components(frame(spark, texts), k=3, num=90, den=100).collect()}
    assert got == want and max(want.values()) > 10


def test_jaccard_of_an_empty_table(spark):
    assert jaccard_components(frame(spark, [])).count() == 0


@given(st.lists(st.integers(1, 50), max_size=80), st.integers(1, 6))
@settings(max_examples=60, deadline=None)
def test_bins_are_gapless_and_within_size(lengths, capacity):
    bins, filled = OpenBins(50, capacity), {}
    for length in lengths:
        found, offset = bins.place(length)
        assert offset == filled.get(found, 0)
        filled[found] = offset + length
        assert filled[found] <= 50 and bins.count <= capacity


def test_fullest_that_fits_is_taken_and_fullest_closes():
    bins = OpenBins(10, 2)
    assert [bins.place(n)[0] for n in (6, 7, 3, 4)] == [0, 1, 1, 0]
    bins = OpenBins(10, 2)
    assert [bins.place(n)[0] for n in (6, 7, 8, 3, 4)] == [0, 1, 2, 0, 3]  # 1 closes for 2, then 0, by now the fullest, for 3


@given(st.integers(1, 300), st.integers(1, 60))
def test_cut_covers_a_document(length, limit):
    pieces = cut(length, limit)
    assert [s for s, _ in pieces] == list(np.cumsum([0, *[n for _, n in pieces]])[:-1])
    assert sum(n for _, n in pieces) == length and all(n == limit for _, n in pieces[1:]) and 1 <= pieces[0][1] <= limit


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(BYTE_BPE)
    texts = odd_texts()
    pieces = pack_documents(frame(spark, texts), BYTE_BPE, limit=256)
    got, places, docs = pieces.collect(), {}, {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append((r.piece, r.start, r.ids))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    want = {}
    for d, t in texts:
        want.setdefault(d, []).append([*model.encode(t or "", add_special_tokens=False).ids, 0])
    for d, ids in want.items():
        assert sorted(i for _, _, piece in docs[d] for i in piece) == sorted(i for one in ids for i in one)
    assert [i for _, _, piece in sorted(docs[9]) for i in piece] == want[9][0]
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    slim = pack_documents(frame(spark, texts), BYTE_BPE, limit=256, ids=False)
    assert "ids" not in slim.columns and sorted(map(str, slim.collect())) == sorted(map(str, pieces.drop("ids").collect()))
    total = sum(r.length for r in got)
    assert len(places) <= -(-total // 256) + 2
    assert pack_documents(frame(spark, []), BYTE_BPE).count() == 0


@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
@settings(max_examples=150, deadline=None)
def test_fast_encoder_gives_the_library_ids(text):
    from tokenizers import Tokenizer

    test_fast_encoder_gives_the_library_ids.model = getattr(test_fast_encoder_gives_the_library_ids, "model", None) or Tokenizer.from_file(BYTE_BPE)
    want = test_fast_encoder_gives_the_library_ids.model.encode(text, add_special_tokens=False).ids
    assert packing.encode(BYTE_BPE, text).tolist() == want


@pytest.mark.parametrize("text", [" " * 3_000_000 + "a", "\n" * 1_000_000, "x" + " \n" * 600_000 + "\t b <|endoftext|>" + "\u3000" * 700_000, "a" * 3_000_000, "a b" + " " * 800_000 + "z" + "\x1c" * 50])
def test_long_runs_give_the_library_ids(text):
    from tokenizers import Tokenizer

    assert encode(BYTE_BPE, text).tolist() == Tokenizer.from_file(BYTE_BPE).encode(text, add_special_tokens=False).ids


def test_tails_of_tasks_share_sequences(spark):
    rng = random.Random(12)
    docs = frame(spark, [(i, prose(rng, rng.randrange(1, 60))) for i in range(300)]).repartition(40)
    got = pack_documents(docs, BYTE_BPE, limit=512).collect()
    spans = {}
    for r in got:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in spans.values():
        assert [o for o, _ in sorted(own)] == list(np.cumsum([0, *[n for _, n in sorted(own)]])[:-1]) and sum(n for _, n in own) <= 512
    assert len(got) == 300 and len(spans) <= -(-sum(r.length for r in got) // 512) * 1.06 + 1


@given(st.text(alphabet="ab \n<|endoftx>é́ﬁ'st", max_size=400), st.integers(8, 40), st.integers(1, 8))
@settings(max_examples=150, deadline=None)
def test_spliced_counts_are_exact(text, chunk, overlap):
    many, one = counter(WORD_BPE)
    assert count_spliced(text, one, chunk, overlap) == many([text])[0]


def test_token_counts(spark):
    many, _ = counter(WORD_BPE)
    texts = odd_texts()
    got = count_tokens(frame(spark, texts), WORD_BPE, limit=500, chunk_chars=1000, overlap_chars=20).collect()
    want = sorted(((d, len((t or "").encode()), many([t or ""])[0]) for d, t in texts), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == want
    assert all(r.over_limit == (r.n_tokens > 500) for r in got)
    assert count_tokens(frame(spark, []), WORD_BPE).count() == 0
    piece = str(public_tokenizers.path("piece_bpe_32k.model"))
    assert count_tokens(frame(spark, [(1, "hola mundo")]), piece).first().n_tokens == tokencount.counter(piece)[0](["hola mundo"])[0]


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 12, 30):
        code = codewords(n)
        gaps = (code[:, None] != code[None]).sum(2) + 1000 * np.eye(n, dtype=int)
        assert code.shape[0] == n and gaps.min() >= 1 and (n < 4 or gaps.min() >= 3)


def test_long_texts_have_the_grams_of_whole_ones():
    rng = random.Random(1)
    texts = pa.array(["".join(rng.choice("abcñé 1.Ü") for _ in range(n)) for n in (0, 5, 300, 7, 1000)] + [None])
    found = []
    for size in (1 << 20, 50):
        own = {}
        for row, stop, buckets, bounds in grams(texts, size):
            for i in range(stop - row):
                own.setdefault(row + i, []).extend(buckets[bounds[i] : bounds[i + 1]].tolist())
        found.append(own)
    assert found[0] == found[1] and len(found[0][4]) > 1000


def test_decoding_matches_brute_force():
    rng = random.Random(11)
    counts = np.zeros((3, BUCKETS))
    train = [("".join(rng.choice(a) for _ in range(80)), i) for i, a in enumerate(("abcd ", "cdef ", "efab ")) for _ in range(20)]
    for text, i in train:
        for _, _, buckets, _ in grams(pa.array([text])):
            np.add.at(counts[i], buckets, 1)
    model = LanguageCode(["x", "y", "z"], counts)
    model.weight = np.array([1.0, 0.5, 2.0])
    texts = ["abca dab", "fefd e", "cc dd", ""]
    share = [[(c + 0.02) / (counts[i][p].sum() + 0.02 * 65536) for c in counts[i][p]] for i in range(3) for p in (slice(0, 65536), slice(65536, BUCKETS))]
    share = [share[2 * i] + share[2 * i + 1] for i in range(3)]
    for text, losses in zip(texts, model.losses(model.margins(pa.array(texts))), strict=True):
        padded, margin = f" {text} ", [0.0] * 3
        for j in range(1, len(padded) - 1):
            if padded[j] == " ":
                continue
            a, b, c = (ord(x) for x in padded[j - 1 : j + 2])
            for bucket in (a * 256 + b, 65536 + (((a * 65536 + b * 256 + c) * 2654435761 % 2**32) >> 16)):
                for bit in range(3):
                    ones = [share[i][bucket] for i in range(3) if model.code[i][bit]]
                    zeros = [share[i][bucket] for i in range(3) if not model.code[i][bit]]
                    margin[bit] += 0.25 * math.log((sum(ones) / len(ones)) / (sum(zeros) / len(zeros)))
        want = [sum(w * math.log1p(math.exp(-m * (1 if on else -1))) for m, on, w in zip(margin, code, model.weight, strict=True)) for code in model.code]
        assert np.allclose(losses, want, rtol=1e-4, atol=1e-4)


def test_language_id(spark):
    rng = random.Random(1)
    alphabets = {"aa": "abcdef ", "bb": "ghijkl ", "cc": "mnopqr "}
    rows = [(i, "".join(rng.choice(alphabets[lang]) for _ in range(60)), lang) for i in range(120) for lang in [list(alphabets)[i % 3]]]
    rows += [(900, None, "aa"), (901, " 12 !", "bb"), (902, "", None), (903, "ghik lij", None), (None, "mnop qr", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("p", F.lit(1)).withColumn("letters", F.lit("x"))
    got = {r.doc_id: r for r in identify(docs).collect()}
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "bb" and got[None].lang_pred == "cc"
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:120]) and got[5].held_out == (zlib.crc32(b"5") % 5 == 0)
    assert identify(docs.where("false")).count() == 0
    assert {r.lang_pred for r in identify(docs.where("lang is null")).collect()} == {"und"}
    assert identify(docs.where("lang = 'aa'")).where("lang_pred <> 'und'").first().lang_pred == "aa"


def test_quality(spark):
    rng = random.Random(2)
    good = [(2 * i, prose(rng, 40) + ".", 1) for i in range(150)]
    bad = [(2 * i + 1, " ".join(w + "$$$" for w in prose(rng, 40).split()), 0) for i in range(60)]
    docs = frame(spark, [(i, t) for i, t, _ in good + bad] + [(990, None), (991, ""), (None, "x")])
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(7, 1), (995, 1), (None, 0), (991, None), (990, 5)], "doc_id long, quality int")
    got = {r.doc_id: r for r in score_quality(docs, labels, metadata=("n",)).collect()}
    held = [(i, q) for i, _, q in good + bad if got[i].held_out]
    assert sum(got[i].predicted == q for i, q in held) >= 0.9 * len(held) and len(got) == 213
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.score for r in score_quality(docs, labels.where("false")).collect()} == {0.5}
    assert score_quality(docs.where("false"), labels).count() == 0


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    model = FactorisationMachine(3)
    index, value = np.array([5, 9, 9 + 7]), rng.normal(size=3)
    raw, _, _ = model.raw(index, value, np.array([0, 3]))
    pairs = sum(model.factor[index[i]] @ model.factor[index[j]] * value[i] * value[j] for i in range(3) for j in range(i))
    assert np.isclose(raw[0], model.bias + model.linear[index] @ value + pairs)


def test_passages(spark):
    rng = random.Random(4)
    passage = prose(rng, 70)
    texts = [(i, f"{prose(rng, 30)}\n{prose(rng, 13)} {passage if i % 3 == 0 else prose(rng, 70)} {prose(rng, 20)}") for i in range(12)]
    texts += [(50, None), (51, ""), (52, passage.upper()), (52, passage.upper()), (None, passage)]
    docs = frame(spark, texts)
    spans = repeated_spans(docs)
    got = spans.collect()
    assert {r.doc_id for r in got} == {3, 6, 9, 52} and {r.kept_doc_id for r in got} == {0}
    held = dict(texts)
    for r in got:
        piece = held[r.doc_id][r.start : r.end]
        assert piece.lower() in passage and len(piece.split()) >= 40
    cut_ = {r.doc_id: r.text for r in remove_spans(docs, spans).collect()}
    for d, t in texts:
        own = sorted((r.start, r.end) for r in got if r.doc_id == d)
        for a, b in reversed(own):
            t = t[:a] + t[b:]
        assert cut_[d] == t
    assert remove_spans(docs, spans).columns == docs.columns and repeated_spans(docs.where("false")).count() == 0


def test_passages_repeated_within_a_document(spark):
    rng = random.Random(14)
    passage, other = prose(rng, 70), prose(rng, 60)
    texts = [(1, "\n".join([passage, other, passage, prose(rng, 30), passage])), (2, "kan lor mis\n" * 60), (3, f"{prose(rng, 40)}\n{other}")]
    docs = frame(spark, texts)
    spans = repeated_spans(docs)
    assert {(r.doc_id, r.kept_doc_id) for r in spans.collect()} == {(1, 1), (2, 2), (3, 1)}
    left = {r.doc_id: r.text for r in remove_spans(docs, spans).collect()}
    assert left[1].startswith(f"{passage}\n{other}\n") and left[1].count(passage) == 1 and len(left[1].split()) <= 70 + 60 + 30 + 2 * 30
    assert left[2].split() == "kan lor mis".split() * 9 and left[3].startswith(texts[2][1].split("\n")[0])


def brute_spans(texts, least):
    """Spans by plain dictionaries of word tuples; only where a piece is cut comes from the words' hashes."""
    seen = {}
    for doc, text in texts:
        if doc is None or text is None:
            continue
        words = [(m.start(), m.end(), re.sub("[A-Z]", lambda c: c[0].lower(), m[0])) for m in re.finditer(r"[^\x20\x09-\x0d]+", text)]
        if len(words) < least:
            continue
        ends = [next(iter(word_hashes(pa.array([w]))))[2][0] & np.uint64(3) == 0 for _, _, w in words]
        feeds = [text[a[1] : b[0]].count("\n") for a, b in zip(words, words[1:], strict=False)]
        inner = range(1, len(words))
        units = set()
        for kind in (lambda i: feeds[i - 1] > 0, lambda i: feeds[i - 1] > 1):
            cuts = [0, *[i for i in inner if kind(i)], len(words)]
            units |= {(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b - a >= least}
        cuts = [0, *[i for i in inner if ends[i - 1] or feeds[i - 1] > 0], len(words)]
        units |= {(a, min(long)) for a in cuts if (long := [b for b in cuts if b - a >= least])}
        for a, b in units:
            seen.setdefault(tuple(w for _, _, w in words[a:b]), []).append((doc, words[a][0], words[b - 1][1]))
    spans = {}
    for places in seen.values():
        first = min(places)
        for doc, start, end in places:
            if doc > first[0] or start >= first[2]:
                spans.setdefault(doc, []).append((start, end, first[0]))
    out = []
    for doc, own in spans.items():
        merged = []
        for start, end, kept in sorted(own):
            if merged and start <= merged[-1][1]:
                merged[-1] = [merged[-1][0], max(merged[-1][1], end), min(merged[-1][2], kept)]
            else:
                merged.append([start, end, kept])
        out += [(doc, *m) for m in merged]
    return sorted(out)


def test_passages_match_brute_force(spark):
    rng = random.Random(23)
    shared = [prose(rng, n) for n in (26, 30, 60, 12)]
    texts = [(50, None), (51, ""), (52, " \n ")]
    for i in range(30):
        parts = [rng.choice(shared) if rng.random() < 0.5 else prose(rng, rng.randrange(1, 40)) for _ in range(rng.randrange(1, 7))]
        texts.append((i, "".join(p + rng.choice([" ", "\n", "\n\n", "\n \n", "  "]) for p in parts)))
    texts.append((60, texts[5][1].upper()))
    got = sorted((r.doc_id, r.start, r.end, r.kept_doc_id) for r in repeated_spans(frame(spark, texts)).collect())
    assert got == brute_spans(texts, 25) and len(got) > 15


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("dim", F.lit("x")).withColumn("ids", F.lit(1)).withColumn("q", F.lit(2))


def odd_vectors(n=400):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(n)]
    rows += [(n + i, rows[50][1]) for i in range(20)]  # copies of a query
    return rows + [(1000, None), (1050, [float("nan")] * 8), (1100, [1.0, None] + [0.0] * 6), (1150, [0.0] * 8), (1200, [float("inf")] * 8), (1250, [1.0, 2.0]), (1300, [2.0, 2.0]), (1350, []), (None, [1.0] * 8)]


def usable(rows, zero):
    return [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and (zero or any(v))]


def test_exact_top_k(spark):
    rows = odd_vectors()
    got = {}
    for r in exact_top_k(vectors(spark, rows), every=50, k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = [(i, np.floor(256 * v).astype(np.int64)) for i, v in usable(rows, True)]
    want = {}
    for q, x in whole:
        if q % 50 == 0 and (found := sorted((-int(x @ y), i) for i, y in whole if i != q and len(y) == len(x))[:5]):
            want[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(found)]
    assert {q: sorted(v) for q, v in got.items()} == want
    assert exact_top_k(vectors(spark, [])).count() == 0


def test_large_vectors_and_repeated_ids(spark):
    rows = [(0, [1.0, 2.0]), (50, [300000.0, 1.0]), *[(7, [3.0, 4.0])] * 9, (8, [3.0, 1.0]), (9, [2.0**21, -5.0]), (10, [1.0, 1.0])]
    whole = {i: [int(256 * x) for x in v] for i, v in rows}
    score = lambda a, b: sum(x * y for x, y in zip(whole[a], whole[b], strict=True))
    got = {(r.query_id, r.vec_id): r.score for r in exact_top_k(vectors(spark, rows), every=50, k=5).collect()}
    assert got == {(q, i): score(q, i) for q in (0, 50) for i in whole if i != q}
    near = nearest_neighbours(vectors(spark, rows), every=50, k=3).where("query_id = 0").collect()
    assert [r.vec_id for r in sorted(near, key=lambda r: r["rank"])] == [10, 8, 7]
    near = nearest_neighbours(vectors(spark, rows[2:11] + [rows[0], rows[12]]), every=50, k=2).collect()
    assert [r.vec_id for r in sorted(near, key=lambda r: r["rank"])] == [7, 9]


def test_nearest_neighbours(spark):
    rows = odd_vectors(970)
    got = {}
    for r in nearest_neighbours(vectors(spark, rows), every=100, k=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole, hits, total = usable(rows, False), 0, 0
    assert 1150 not in got or all(i != 1150 for _, i, _ in got[1150])
    for q, x in whole:
        if q % 100 == 0 and q in got:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in whole if i != q and len(y) == len(x))[:10]
            hits += len({i for _, i in near} & {i for _, i, _ in got[q]})
            total += len(near)
            assert [n for n, _, _ in sorted(got[q])] == list(range(1, len(near) + 1))
            assert all(np.isclose(s, np.sqrt(((x - dict(whole)[i]) ** 2).sum()), rtol=0, atol=1e-12) for _, i, s in got[q])
    assert hits >= 0.9 * total
    assert nearest_neighbours(vectors(spark, [])).count() == 0


def test_line_templates(spark):
    rng = random.Random(9)
    texts = [(i, f"{prose(rng, 8)}\nPublicado el día {i + 10} de mayo\ncorta\n\tAviso   legal de la casa {chr(97 + i)}") for i in range(8)]
    texts += [(20, None), (21, ""), (22, "Publicado el día 99 de mayo"), (22, "Publicado el día 99 de mayo"), (None, "Publicado el día 5 de mayo")]
    got = {r.doc_id: r for r in drop_templates(frame(spark, texts), min_docs=5).collect()}
    assert got[0].text == texts[0][1] and got[0].n_dropped == 0
    assert got[0].n_lines == 4 and got[3].text == texts[3][1].split("\n")[0] and got[3].n_dropped == 3
    assert (got[20].text, got[20].n_lines) == (None, 0) and (got[21].text, got[21].n_lines) == ("", 1)
    assert got[22].text == "" and got[None].text == ""
    assert drop_templates(frame(spark, texts)).count() == len(texts) and drop_templates(frame(spark, [])).count() == 0


def test_a_leaf_holds_several_templates(spark):
    rng = random.Random(19)
    names = ["Ana", "Luz", "Eva", "Sol", "Paz", "Mar", "Ada", "Lia", "Noa", "Zoe"]
    one = [(i, f"{prose(rng, 8)}\nEl pedido de {names[i]} sale hoy del almacén\nn. {i}\n42") for i in range(10)]
    two = [(20 + i, f"El pedido de casa llega con {names[i]} mañana temprano\n12 13\n\nFin.") for i in range(10)]
    common = [(40 + i, f"El pedido de casa llega con {'Rosa' if i < 6 else 'Inma'} mañana temprano") for i in range(8)]
    texts = one + two + common + [(60, "El pedido de agua no cabe en esta caja verde")]
    got = {r.doc_id: r for r in drop_templates(frame(spark, texts), keep=["label"]).collect()}
    assert got[0].text == one[0][1] and all(got[i].text == one[i][1].split("\n")[0] + "\n42" for i in range(1, 10))
    assert got[20].text == two[0][1] and all(got[i].text == "12 13\n" for i in range(21, 30))
    assert all(got[i].text == "" for i in range(40, 48)) and got[60].text == texts[-1][1] and got[0].label == "x"


def _without_broadcast(monkeypatch, frame_of):
    with monkeypatch.context() as patch:
        patch.setattr("vellum.llm.mixing.BROADCAST_BYTES", -1)
        return frame_of().collect()


def test_lines_are_dropped_in_linear_time(spark):
    import time

    line = lambda i: f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} {i % 7} of {'uvwxyzabcd'[i // 100 % 10]} things seen here"
    long = "\n".join(line(i) for i in range(200_000))
    table = spark.createDataFrame([(i, long if i == 9 else "\n".join(line(j) for j in range(1000))) for i in range(10)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in drop_templates(table).collect()}
    assert time.perf_counter() - began < 60
    assert got[9]["n_lines"] == 200_000 == got[9]["n_dropped"] and got[9]["text"] == "" and got[0]["n_dropped"] == 0


def test_lines_that_no_template_can_hold_are_written_as_numbers(spark, monkeypatch):
    """Texts are not written again, few rows outlive the first step, and shuffled joins give the same."""
    rng = random.Random(29)
    line = lambda: " ".join(f"{rng.choice('abcdef')}{rng.getrandbits(60):x}q".translate(str.maketrans("0123456789", "ghijklmnop")) for _ in range(12))
    names = ["Ana", "Luz", "Eva", "Sol", "Paz", "Mar"]
    rows = [(i, "\n".join(line() for _ in range(400)) + f"\nEl pedido de {names[i % 6]} sale hoy del almacén") for i in range(12)]
    table = spark.createDataFrame([*rows, rows[3], rows[3]], "doc_id long, text string").localCheckpoint()
    sizes, keep = {}, templates.Scratch.keep

    def kept(self, df, name, by=None):
        out = keep(self, df, name, by)
        sizes[name] = sum(f.stat().st_size for f in Path(self.base.removeprefix("file:"), name).glob("*.parquet"))
        return out

    monkeypatch.setattr(templates.Scratch, "keep", kept)
    got = sorted((r.doc_id, r.n_dropped, r.text) for r in drop_templates(table).collect())
    assert sum(sizes.values()) < 0.5 * sum(len(t) for _, t in rows)
    assert [n for _, n, _ in got] == [0] + [1] * 13 and got[1][2] == rows[1][1].rsplit("\n", 1)[0]
    monkeypatch.setattr("vellum.sources.scratch.BROADCAST_BYTES", -1)
    assert sorted((r.doc_id, r.n_dropped, r.text) for r in drop_templates(table).collect()) == got


def test_mixing_budgets(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 3), "abc"[i % 3], "xy"[i % 2]) for i in range(60)] + [(90, None, "a", "x"), (None, "w", None, "y"), (91, "", "c", None)], "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("tokens", F.lit("q")).withColumn("range", F.lit(1)).withColumn("budget", F.lit(2))
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    total = 20 * (1 + 2 + 3) + 1
    got = mixing.mix_sources(docs, levels, [{"a": 2, "b": 1, "c": 1}, {}], budget=80, max_epochs=2).groupBy("lang").agg(F.sum("taken").alias("n")).collect()
    n = {r.lang: r.n for r in got}
    assert n["a"] == 39 and n["(none)"] == 2 and n["b"] + n["c"] == 39 and sum(n.values()) == 80  # what (none) lacks goes 2:1:1, nothing is left over
    everything = mixing.mix_sources(docs, levels, [{}, {}], budget_share=5.0, max_epochs=2)
    assert everything.agg(F.sum("taken")).first()[0] == 2 * total
    one = mixing.mix_sources(docs, levels, [{}, {}], budget_share=0.5, max_epochs=1)
    assert abs(one.agg(F.sum("taken")).first()[0] - total // 2) <= 8 and one.groupBy("doc_id").count().where("count > 1").count() == 0
    assert mixing.mix_sources(docs, levels, [{"a": 0}, {}]).where("lang = 'a'").count() == 0
    whole = {(r.doc_id, r.epoch): (r.start, r.taken) for r in everything.collect()}
    shuffled = {(r.doc_id, r.epoch): (r.start, r.taken) for r in _without_broadcast(monkeypatch, lambda: mixing.mix_sources(docs, levels, [{}, {}], budget_share=5.0, max_epochs=2))}
    assert whole == shuffled and all(s is not None for s, _ in whole.values()) and whole[(3, 1)][0] != whole[(3, 2)][0]
    assert mixing.mix_sources(docs.where("false"), levels, [{}, {}]).count() == 0
