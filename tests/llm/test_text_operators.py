import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from annotide.llm import encoding as en
from annotide.llm import format_copies as fc
from annotide.llm import packing as pk
from annotide.llm import readability as rd
from annotide.llm import shared_spans as ss
from annotide.llm import split_overlap as so
from annotide.storage import Scratch

RECORDS = "source_row long, target string, partition string, cid string, words string"
SPLITS = "source_row long, partition string, target string"


# --- cross-split overlap -------------------------------------------------------------------------------------------


def brute_pairs(records, splits):
    side = {r: p == "train" for r, p in splits if r is not None and p is not None}
    bags = {r: Counter(re.findall(r"[^\W_]+", (t or "").casefold())) for r, t in records if r in side}
    out = set()
    for a, x in bags.items():
        for b, y in bags.items():
            if side[a] and not side[b] and x and y and 5 * sum((x & y).values()) >= 4 * max(sum(x.values()), sum(y.values())):
                out.add((b, a))
    return out


def cross(spark, records, splits):
    df = spark.createDataFrame([(r, t, "train", "x", "y") for r, t in records], RECORDS)
    sp = spark.createDataFrame([(r, p, "clash") for r, p in splits], SPLITS)
    return so.cross_split_pairs(df, sp)


@pytest.mark.parametrize("seed", range(4))
def test_cross_split_pairs_equal_brute_force(spark, seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)] + ["Éa", "ß", "x9"]
    base = [[r.choice(vocab) for _ in range(r.randrange(1, 14))] for _ in range(15)]
    records = []
    for i in range(120):
        words = list(r.choice(base))
        for _ in range(r.randrange(4)):
            words[r.randrange(len(words))] = r.choice(vocab)
        r.shuffle(words)
        records.append((i, r.choice((" ", ", ", "\n-")).join(w.upper() if r.random() < 0.3 else w for w in words)))
    splits = [(i, r.choice(("train", "train", "test", "dev_tune"))) for i in range(120)]
    got = cross(spark, records, splits)
    assert {(x["row_other"], x["row_train"]) for x in got.collect()} == brute_pairs(records, splits)
    assert got.count() == got.distinct().count() and got.agg(F.min("cosine")).first()[0] >= 0.8 - 1e-9


def test_cross_split_hard_rows(spark, monkeypatch):
    records = [(None, "a b"), (1, None), (2, ""), (3, "!!"), (4, "a b"), (4, "a b"), (5, "A, b"), (6, "a b"), (7, "z " * 20_000), (8, "Z " * 19_000)]
    splits = [(1, "train"), (2, "test"), (3, "test"), (4, "train"), (4, "train"), (5, "test"), (6, None), (None, "train"), (7, "train"), (8, "test")]
    got = {(x["row_other"], x["row_train"]) for x in cross(spark, records, splits).collect()}
    assert got == {(5, 4), (8, 7)}
    assert cross(spark, [], []).count() == 0 and cross(spark, records, []).count() == 0


def test_cross_split_hot_words_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(so, "HELD", 7)
    monkeypatch.setattr(so, "STREAMED", 5)
    records = [(i, f"the same words again but number {i // 3}") for i in range(90)]
    splits = [(i, "train" if i % 2 else "test") for i in range(90)]
    assert {(x["row_other"], x["row_train"]) for x in cross(spark, records, splits).collect()} == brute_pairs(records, splits)


def test_report(spark):
    records, splits = [(1, "a b c"), (2, "a b c"), (3, "d")], [(1, "train"), (2, "test"), (3, "test")]
    df = spark.createDataFrame([(r, t, s) for (r, t), s in zip(records, ("x", " X", "x"), strict=True)], "source_row long, target string, source string")
    out = so.overlap_report(df, spark.createDataFrame(splits, "source_row long, partition string")).collect()
    assert [(r["partition"], r["source"], r["n_windows"], r["n_overlapping"]) for r in out] == [("test", "x", 2, 1)]


def test_a_hot_word_outside_the_broadcast_table(spark, monkeypatch):
    monkeypatch.setattr(so, "TOP_WORDS", 5)
    monkeypatch.setattr(so, "HELD", 20)
    r = random.Random(3)
    # the five broadcast words are in all texts; "zz" is in most of the test texts, too, and in train texts more than once
    records = [(i, "a b c d e zz " + " ".join(f"u{r.randrange(6)}" for _ in range(4)) + " zz" * (i % 3)) for i in range(90)]
    splits = [(i, "train" if i % 2 else "test") for i in range(90)]
    df = spark.createDataFrame(records, "source_row long, target string")
    sp = spark.createDataFrame(splits, "source_row long, partition string")
    want = brute_pairs(records, splits)
    assert {(x["row_other"], x["row_train"]) for x in so.cross_split_pairs(df, sp).collect()} == want
    found = so.overlapping_records(*so.matched_classes(df, sp))
    assert {x["row"] for x in found.collect()} == {a for a, _ in want}


def test_equal_texts_give_linear_reports(spark):
    n = 3000
    records = spark.range(n).select(F.col("id").alias("source_row"), F.lit("The very same words, again.").alias("target"), F.lit("s").alias("source"))
    splits = spark.range(n).select(F.col("id").alias("source_row"), F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("partition"))
    pairs, _ = so.matched_classes(records, splits)
    assert pairs.count() == 1
    row = so.overlap_report(records, splits).collect()
    assert [(r["n_windows"], r["n_overlapping"], r["share"]) for r in row] == [(n // 2, n // 2, 1.0)]


# --- copies hidden by formatting -----------------------------------------------------------------------------------


def test_canonical_forms():
    same = lambda a, b: fc.canonical(a) == fc.canonical(b)
    assert same("Hello, World!", " hello​world ") and not same("ab c", "a bd")
    assert same("a: 1; b: 2; c: 3", "C : 3 | A: 1|b:2\n") and not same("a: 1; b: 2", "b: 2; a: 1")
    assert not same("a: 1; b: 2; c", "c; a: 1; b: 2") and fc.canonical(" \n") is None and fc.canonical(None) is None


@pytest.mark.parametrize("bits", [1 << 10, 1 << 12, 1 << 19])
def test_copies_equal_brute_force_whatever_the_size_of_a_filter(spark, monkeypatch, bits):
    monkeypatch.setattr(fc, "BLOCK_BITS", min(bits, 1 << 10))
    r = random.Random(5)
    texts = [f"Text {r.randrange(400)}" for _ in range(900)] + ["hot copy"] * 400 + [None, "", "  ", "..."]
    rows = [(i, r.choice((str.upper, str.lower, lambda s: s.replace(" ", "\n\t") + "!"))(t) if t else t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in [*rows, rows[0], (None, "hot copy")]], "source_row long, target string, first string").repartition(6)
    sets = {}
    for i, t in rows:
        if fc.canonical(t) is not None:
            sets.setdefault(fc.canonical(t), []).append(i)
    assert {tuple(x) for x in fc.copy_pairs(df, most_bits=bits).collect()} == {(min(s), i) for s in sets.values() for i in s if i != min(s)}
    got = fc.copy_groups(df, most_bits=bits).collect()
    assert len(got) == sum(map(len, sets.values()))
    assert {(x["row"], x["first"], x["n_copies"]) for x in got} == {(i, min(s), len(s)) for s in sets.values() for i in s}


def test_small_filters_still_sift(spark, monkeypatch):
    monkeypatch.setattr(fc, "BLOCK_BITS", 1 << 13)
    n = 4000
    df = spark.range(n).select(F.col("id").alias("source_row"), F.concat(F.lit("text "), F.when(F.col("id") < 100, 0).otherwise(F.col("id"))).alias("target"))
    hashed = fc.hashed_records(df.repartition(4), Scratch(spark, "t"), most_bits=1 << 13)  # eight parts
    assert hashed.count() == n
    assert hashed.where("maybe and row < 100").count() == 100
    assert hashed.where("maybe and row >= 100").count() < 0.01 * n


def test_no_copies(spark):
    empty = spark.createDataFrame([], "source_row long, target string")
    assert fc.copy_pairs(empty).count() == fc.copy_groups(empty).count() == 0


# --- shared spans --------------------------------------------------------------------------------------------------


def brute_spans(rows, span):
    grams = {}
    for row, *texts in rows:
        for t in texts:
            for i in range(len(t or "") - span + 1):
                grams.setdefault(t[i : i + span], set()).add(row)
    return {(a, b) for s in grams.values() for a in s for b in s if None not in (a, b) and a < b}, grams


@pytest.mark.parametrize("seed", range(3))
def test_shared_spans_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(ss, "PASSAGES", 20)
    monkeypatch.setattr(ss, "RECORDS", 15)
    r = random.Random(seed)
    alphabet = "ab é\U0001f600"
    piece = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    pool = [piece(n) for n in (79, 80, 81, 100, 150, 300)]
    rows = [(i, *(r.choice((None, "", piece(30) + r.choice(pool) + piece(20), piece(120), "ab" * 70)) for _ in range(3))) for i in range(60)]
    df = spark.createDataFrame(rows, "source_row long, preceding string, target string, following string").withColumn("row", F.lit(1)).withColumn("h", F.lit("x"))
    spans = ss.shared_spans(df, span=80).cache()
    want, grams = brute_spans(rows, 80)
    assert {(x["row_1"], x["row_2"]) for x in spans.collect()} == want
    text = {row: texts for row, *texts in rows}
    for x in spans.collect():
        a, b = text[x["row_1"]][x["field_1"]], text[x["row_2"]][x["field_2"]]
        assert x["length"] >= 80 and a[x["start_1"] : x["start_1"] + x["length"]] == b[x["start_2"] : x["start_2"] + x["length"]]
    share = {x["row"]: x for x in ss.shared_share(df, span=80).collect()}
    for row, *texts in rows:
        covered = 0
        for t in texts:
            marks = np.zeros(len(t or ""), bool)
            for i in range(len(t or "") - 79):
                if len(grams[t[i : i + 80]]) > 1:
                    marks[i : i + 80] = True
            covered += int(marks.sum())
        assert share[row]["n_shared"] == covered


def test_shared_spans_hard_rows(spark):
    long = "".join(chr(97 + (i * i) % 26) for i in range(5000))
    schema = "source_row long, preceding string, target string, following string"
    rows = [(None, long, None, None), (1, long, None, None), (1, long, None, None), (2, "", None, "x" + long[100:900]), (3, long[:159], None, None)]
    assert {(x["row_1"], x["row_2"]) for x in ss.shared_spans(spark.createDataFrame(rows, schema)).collect()} == {(1, 2)}
    assert ss.shared_spans(spark.createDataFrame([], schema)).count() == 0
    assert ss.shared_share(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        ss.shared_spans(spark.createDataFrame([], schema), span=10)


def test_the_share_makes_no_pairs(spark):
    boilerplate = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(200))
    rows = [(i, f"{i:04d} starts here. {boilerplate} and {i * 7919:08d} ends.", None, None) for i in range(2000)]
    df = spark.createDataFrame(rows, "source_row long, preceding string, target string, following string")
    out = ss.shared_share(df).collect()
    assert len(out) == 2000 and all(r["n_shared"] >= 200 + len(" starts here. ") + len(" and ") for r in out)


# --- encoding and packing ------------------------------------------------------------------------------------------

TEXTS = [None, "", " ", "Hello there, it's me.", "word " * 3000, "x" * 20_000, "\n\n  \t" * 2000, "日本語のテキスト" * 900, "áb " * 2000, "\U0001f600 ok " * 1500, "1234567890" * 900, "Don't we'll they've " * 600, "<|endoftext|> plain"]


def test_encoding_is_exact(spark):
    r = random.Random(2)
    mixed = ["".join(r.choice(("word", " ", "  ", "\n", "'s", "é", "9", "-", "語", "The cat", "　")) for _ in range(r.randrange(3000))) for _ in range(25)]
    texts = TEXTS + mixed + ["word " * 3000, mixed[0] + mixed[1]]
    rows = [(i % 30 if i else None, t, "x") for i, t in enumerate(texts)]
    got = en.encoded(spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3))
    tokens = en.codec("byte_bpe_50k")
    want = sorted(((k, tuple(tokens.encode(t) if t else ())) for k, t, _ in rows), key=repr)
    assert sorted(((x["doc_id"], tuple(x["ids"])) for x in got.collect()), key=repr) == want


def test_encoding_equals_the_other_library(spark):
    from pathlib import Path

    tokenizers = pytest.importorskip("tokenizers")
    path = Path(en.TOKENIZERS, "byte_bpe_50k.json")
    if not path.exists():
        pytest.skip("no tokenizer files")
    t = tokenizers.Tokenizer.from_file(str(path))
    t.encode_special_tokens = True
    for text in TEXTS[2:]:
        assert en.codec("byte_bpe_50k").encode(text) == t.encode(text, add_special_tokens=False).ids


def test_encoding_of_nothing(spark):
    assert en.encoded(spark.createDataFrame([], "doc_id string, text string")).count() == 0


@pytest.mark.parametrize("lengths", [(2048,), (512, 1024, 1536, 2048), (300, 2048)])
def test_packing(spark, monkeypatch, lengths):
    monkeypatch.setattr(pk, "PARTS", 3)
    r = random.Random(7)
    sizes = [(i, r.choice((0, 1, 40, 300, 900, 2047, 2048, 2049, 7000)) + r.randrange(3), i) for i in range(800)] + [(None, 5, 1), (900, None, 1), (0, 1, 1)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long, bin long")
    rows = pk.packed(df, lengths=lengths).collect()
    whole = {}
    for k, n, _ in sizes:
        if k is not None and n:
            whole[k] = max(whole.get(k, 0), n)
    pieces, bins = {}, {}
    for x in rows:
        pieces.setdefault(x["item"], []).append((x["start"], x["size"]))
        b = bins.setdefault(x["bin"], [0, x["length"]])
        b[0] += x["size"]
        assert b[1] == x["length"] and x["length"] in {*lengths, 2048}
    assert {k: sum(n for _, n in v) for k, v in pieces.items()} == whole
    for k, v in pieces.items():
        assert len(v) == -(-whole[k] // 2048) and sorted(v) == [(i * 2048, min(2048, whole[k] - i * 2048)) for i in range(len(v))]
    assert all(used <= room for used, room in bins.values())
    assert all(room == min(c for c in {*lengths, 2048} if c >= used) for used, room in bins.values())
    containers = {}
    for x in {(x["bin"], x["length"], x["container"]) for x in rows}:
        containers[x[2]] = containers.get(x[2], 0) + x[1]
    assert all(n <= 2048 for n in containers.values()) and sorted(containers) == list(range(len(containers)))
    report = {x["length"]: x for x in pk.fill_report(pk.packed(df, lengths=lengths)).collect()}
    assert report[None]["n_containers"] == len(containers) and report[None]["n_tokens"] == sum(whole.values())
    assert report[None]["unused_of_containers"] < 0.02 and sum(x["n_bins"] for k, x in report.items() if k) == len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_every_item_once_and_need_no_more_containers_than_plain_best_fit(seed):
    r = random.Random(seed)
    sizes = [max(1, min(2048, int(r.lognormvariate(*r.choice(((4, 1), (6, 1), (7, 0.5))))))) for _ in range(r.choice((1, 30, 4000)))]
    counts = np.bincount(sizes, minlength=2049)
    plan = pk.best_plan(counts, pk.LENGTHS)
    held = Counter()
    for content, length, times in plan.bins:
        assert times > 0 and length == min(c for c in pk.LENGTHS if c >= sum(content))
        for s in content:
            held[s] += times
    assert held == Counter(sizes)
    room = sorted(sizes, reverse=True)
    plain = []
    for s in room:
        fits = [k for k, left in enumerate(plain) if left >= s]
        if fits:
            plain[min(fits, key=lambda k: plain[k])] -= s
        else:
            plain.append(2048 - s)
    assert plan.cost()[0] <= len(plain)


def test_short_lengths_are_opened_where_they_pay():
    counts = np.bincount([256] * 400 + [1536] * 100, minlength=2049)
    plan = pk.best_plan(counts, pk.LENGTHS)
    assert plan.cost() == (125, 100 * 1536**2 + 200 * 512**2)
    assert pk.Plan(np.bincount([1500, 1000, 548, 500], minlength=2049), (2048,)).cost()[0] == 2
    assert pk.best_plan(np.zeros(2049, dtype=int), pk.LENGTHS).bins == []


def test_packing_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert pk.packed(empty).count() == 0 and pk.fill_report(pk.packed(empty)).first()["unused_of_containers"] is None
    with pytest.raises(ValueError):
        pk.packed(empty, container=100)


def test_counts_equal_encoding(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in en.token_counts(df).collect()}
    assert got == {i: len(en.codec("byte_bpe_50k").encode(t)) if t else 0 for i, t in enumerate(TEXTS)}


# --- reading level -------------------------------------------------------------------------------------------------


SYLLABLES = [(w, n) for n, words in {
    1: "eye cream blue guide guess", 2: "being science create poem chaos cruel naive people lion quiet union prism conscience million",
    3: "opinion influence theory museum reaction period religious", 4: "cooperate society variety continuous algorithm reinforcing",
}.items() for w in words.split()]


@pytest.mark.parametrize(("word", "n"), [("cat", 1), ("table", 2), ("make", 1), ("jumped", 1), ("wanted", 2), ("nation", 2), ("idea", 3), ("the", 1), ("beautiful", 3), ("institution", 4), ("boxes", 2), ("rhythm", 2), *SYLLABLES])
def test_syllables(word, n):
    assert rd.syllables(word) == n


EASY = "The cat sat on the mat. It was a good cat. We like the cat a lot. She has a red hat. He ran to the big park. The dog ran too. Mum read us a book at night. It was fun. We went to bed. The end was sad for me. I did not cry."
HARD = "Previous methodological literature has predominantly interpreted representation as an individual characteristic, thereby obscuring the institutional mechanisms through which communication and interpretation become mutually reinforcing. "


def level(text):
    found = rd.sentences(text)
    return sorted(rd.grades(found).values())[2:4]


def test_layout_does_not_matter():
    easy = max(level(EASY))
    for laid in (EASY.upper(), EASY.replace(". ", "\n"), "\n".join("- " + s for s in EASY.split(". ")), EASY.replace(" ", "  "), "> " + EASY.replace(". ", ".\n> "), "# Heading\n\n" + EASY):
        assert max(level(laid)) < easy + 3
    hard = HARD * 3
    for laid in (hard.lower(), re.sub(r"((?:\S+ ){9}\S+) ", r"\1\n", hard), "- " + hard.replace(", ", ",\n- ")):
        assert min(level(laid)) > easy + 10


def test_one_word_more_changes_a_run_on_little():
    words = "the cat sat on the mat and then it ran to the big red park with me".split() * 30
    grade = [sorted(rd.grades(rd.sentences(" ".join(words[:n]))).values()) for n in range(30, 300)]
    assert max(abs(a - b) for x, y in zip(grade, grade[1:], strict=False) for a, b in zip(x, y, strict=True)) < 2.5
    assert grade[-1][2] < grade[10][2]


# own sentences, none from the tables
FOREIGN = {
    "nl": "De commissie heeft in haar laatste vergadering besloten dat de voorgestelde maatregelen onmiddellijk moeten worden ingevoerd, omdat de toestand in de steden anders verder zou verslechteren. Veel bewoners waren het daar niet mee eens en wilden eerst meer onderzoek.",
    "sv": "Regeringen meddelade i torsdags att den nya lagen ska börja gälla under hösten, trots att flera partier har uttryckt stark kritik mot förslaget. Många människor undrar hur det ska gå till och vem som ska betala för allt.",
    "no": "Regjeringen sa torsdag at den nye loven skal tre i kraft til høsten, selv om flere partier har kommet med sterk kritikk av forslaget. Mange mennesker lurer på hvordan det skal gå og hvem som skal betale for alt.",
    "it": "Il governo ha annunciato giovedì che la nuova legge entrerà in vigore in autunno, nonostante le critiche espresse da diversi partiti. Molte persone si chiedono come funzionerà e chi dovrà pagare per tutto questo.",
    "pt": "O governo anunciou na quinta-feira que a nova lei entrará em vigor no outono, apesar das críticas feitas por vários partidos. Muitas pessoas perguntam como vai funcionar e quem terá de pagar por tudo isso.",
}
TABLES = Path("/root/testdata/sf0.01/documents.parquet")


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
def test_languages_beside_the_fitted_ones_are_none_of_them(spark):
    profile = rd.language_profile(spark.read.parquet(str(TABLES)))
    tell = lambda t: profile.language(rd.counted(rd.sentences(t)))
    assert [tell(t) for t in FOREIGN.values()] == [None] * len(FOREIGN)
    assert tell("We asked each of the annotators to read the text twice before they gave a score, and most of them did so without any trouble.") == "en"
    assert tell("") is None


def test_language_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert rd.language_profile(empty).language(Counter(["the"])) is None


def test_levels_of_hard_rows(spark):
    rows = [(1, None), (2, ""), (3, "...\n"), (None, EASY), (5, HARD * 2000), (6, "Das ist nicht gut und die Frage war auch viel zu laut für mich."), (7, EASY), (7, EASY)]
    labelled = [(i, t, lang) for i, (t, lang) in enumerate([(EASY, "en"), (HARD, "en"), ("Die Frage ist nicht gut. Das war mir zu laut und auch viel zu lang für die Kinder. " * 3, "de"), (None, "de"), ("x", "it")])]
    profile = rd.language_profile(spark.createDataFrame(labelled, "doc_id long, text string, lang string"))
    out = rd.reading_levels(spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, grade string"), profile=profile)
    by = {}
    for r in out.collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by[7]) == 2 and by[1][0]["grade"] is by[2][0]["grade"] is by[3][0]["grade"] is None
    assert by[6][0]["language"] == "de" and by[7][0]["language"] == "en" and by[5][0]["grade"] > by[7][0]["grade"] + 10
    assert rd.reading_levels(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    samples = spark.createDataFrame([(EASY, 1), (HARD * 2, 5), (None, 3), ("x", None)], "text string, grade int")
    cut = rd.demanding_from(samples)
    assert [r["doc_id"] for r in rd.demanding(out, cut).collect()] == [5]
    assert rd.demanding_from(samples.where("grade = 1")) == float("inf")
