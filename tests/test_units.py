"""Operators on hand-made cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexfold.functions import normalize as N
from lexfold.functions import stats as P
from lexfold.operators import clustering, components, dedup, entities, production, search, threads
from lexfold.operators.ranks import running
from lexfold.sources import files


def test_compiled_queries_are_well_formed():
    r = random.Random(42)
    bits = ["AND", "OR", "NOT", '"', "word", "x*", "(", ")", "!", "&", "|", "'", "-", "é", '"a b"', "not"]
    atom = r"!?(?:[\w-]+(?::\*)?|\([\w-]+(?: <-> [\w-]+)*\))"
    for _ in range(500):
        q = search.compiled(" ".join(r.choice(bits) for _ in range(r.randint(0, 9))))
        assert q == "" or re.fullmatch(rf"{atom}(?: [&|] {atom})*", q), q


def test_phrases_prefixes_and_precedence(spark):
    d = spark.createDataFrame([(1, "alpha beta gamma"), (2, "Beta alpha"), (3, "gamma, delta"), (4, None)], "doc_id int, text string").withColumn("w", search.tokens(F.col("text")))
    hit = lambda q: [r[0] for r in d.filter(search.matches(F.col("w"), q)).orderBy("doc_id").select("doc_id").collect()]
    assert hit('"alpha beta"') == [1] and hit("alpha beta") == [1, 2] and hit("gam*") == [1, 3]
    assert hit("alpha AND gamma OR delta") == [1, 3] and hit("NOT alpha") == [3, 4] and hit("") == []


def test_term_listed_twice_counts_once(spark):
    d = spark.createDataFrame([(1, 7, "a b"), (2, 7, "c"), (3, None, "a")], "doc_id int, family_id int, text string")
    got = [(r["term"], r["hits"], r["with_families"], r["unique_hits"], r["any_with_families"]) for r in search.term_report(d, ["a", "b", "a", ""]).orderBy("term_no").collect()]
    assert got == [("a", 2, 3, 1, 3), ("b", 1, 2, 0, 3), ("a", 2, 3, 1, 3), ("", 0, 0, 0, 3)]


def test_sample_sizes_and_intervals(spark):
    d = spark.createDataFrame([(100_000,), (500,), (1,)], "n long")
    assert [r[0] for r in d.select(P.sample_size(F.col("n"))).collect()] == [383, 218, 1]
    rate, low, high = spark.range(1).select(*P.wilson(F.lit(10), F.lit(100))).first()
    assert (rate, round(low, 4), round(high, 4)) == (0.1, 0.0552, 0.1744)
    assert spark.range(1).select(*P.wilson(F.lit(0), F.lit(0))).first()[:] == (0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        P.sample_size(F.lit(1), 95, 0)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 100 for i in range(100, 140)) and got[201] == 200
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_threads(spark):
    rows = [
        (1, "<a>", None, None, "Plan", 10), (2, "<b>", "<a>", None, "Re: Plan", 20), (3, "<c>", None, "<x> <b>", "other", 30), (4, "<d>", "<a>", None, "Re: Plan", 5),
        (5, None, None, None, "Lunch", 1), (6, None, None, None, "RE: fwd:  lunch ", 2), (7, None, None, None, "", 3), (8, None, None, None, None, None), (9, "<e>", "<gone>", None, "Plan", 1), (10, "<e>", None, None, "x", 2),
    ]
    d = spark.createDataFrame(rows, "doc_id long, message_id string, in_reply_to string, references string, subject string, date_sent long")
    got = {r["doc_id"]: (r["thread_id"], r["is_inclusive"]) for r in threads.threads(d, 1).collect()}
    t = {k: v[0] for k, v in got.items()}
    assert t[1] == t[2] == t[3] == t[4] and t[5] == t[6] and t[9] == t[10] and len(set(t.values())) == 5
    assert {k for k, v in got.items() if v[1]} == {3, 4, 6, 7, 8, 10}
    assert all(re.fullmatch(r"T-[0-9a-f]{16}", x) for x in t.values())


def test_names(spark):
    cases = {"Rivera, Jorge": "jorge rivera", None: "", "Dr. Jorge Rivera, Jr.": "jorge rivera", "ACME Corp., Inc.": "acme corp inc", "Smith, John, Esq.": "john smith", "O'Brien-Smith": "o brien smith", "Inc.": "inc", "a, b, c": "a b c", "...": "", "Doe, ...": "doe", "Ünal, Jörg, III": "jörg ünal"}
    d = spark.createDataFrame([(k, v) for k, v in cases.items()], "name string, want string")
    assert d.withColumn("got", entities.normal_name(F.col("name"))).filter("got <> want").collect() == []
    usable = spark.createDataFrame([("Li", True), ("C.", False), ("\u201cShe,\u201d", False), ("J.B.", True), ("N/A", False), ("Everyone", False)], "name string, want boolean")
    assert usable.withColumn("got", entities.usable_name(F.col("name"))).filter("got <> want").count() == 0
    assert entities.token_ratio("meridian holdings", "acme corporation") == 0


def test_typo_pairs_are_those_of_all_comparisons(spark):
    r = random.Random(6)
    names = sorted({" ".join(r.choice(["anna", "annaa", "ana", "west", "wests", "we", "wet", "stone", "tone"]) for _ in range(r.randint(1, 3))) for _ in range(60)})
    a = spark.createDataFrame([(n,) for n in names], "a string")
    b = a.withColumnRenamed("a", "b")
    want = a.crossJoin(b).filter(entities.is_typo(F.col("a"), F.col("b"))).collect()
    assert sorted(map(tuple, entities.typo_pairs(a, b).collect())) == sorted(map(tuple, want)) and want


def test_places_of_names_match_a_search_form_by_form():
    of = lambda text, forms: [m[:3] for m in entities.Places(forms).of(text)]
    assert of("Jorge Rivera met Rivera. Riverae J.B. said", ["Rivera", "Jorge Rivera", "J.B."]) == [("Jorge Rivera", 0, 12), ("Rivera", 17, 23), ("J.B.", 33, 37)]
    assert of("a b c", []) == [] and of("", ["a"]) == []
    r = random.Random(3)
    for _ in range(200):
        text = " ".join(r.choice(["ab", "abc", "b", "ab.", "c", "b-c"]) for _ in range(12))
        forms = r.sample(["ab", "abc", "ab abc", "abc b", "b c", "b", "ab.", "b-c", "ab ab"], 5)
        taken, want = [], []
        for f in sorted(forms, key=lambda f: (-len(f), f)):
            for s in range(len(text)):
                e = s + len(f)
                whole = text[s:e] == f and not (s and f[0].isalnum() and re.match(r"\w", text[s - 1])) and not (f[-1].isalnum() and re.match(r"\w", text[e:]))
                if whole and all(e <= x or s >= y for x, y in taken):
                    taken.append((s, e))
                    want.append((f, s, e))
        assert of(text, forms) == sorted(want, key=lambda m: m[1])


def test_numbers_grow_beyond_their_padding_and_parts_agree(spark):
    rows = spark.range(999_990, 1_000_012).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 5 + 1).alias("pages"))
    out = running(rows, ["g"], ["id"], "upto", F.col("pages")).orderBy("id").collect()
    sums = {0: 0, 1: 0, 2: 0}
    for r in out:
        sums[r["g"]] += r["pages"]
        assert r["upto"] == sums[r["g"]]
    m = rows.select(F.lit("s").alias("set_id"), F.col("id").alias("sort_order"), "pages")
    n = production.numbered(m, "P", 6, 999_980).orderBy("sort_order").collect()
    last = 999_979
    for r in n:
        assert int(r["begin"][1:]) == last + 1 and int(r["end"][1:]) == last + r["pages"]
        last = int(r["end"][1:])
    assert last > 1_000_000


def test_production_rules(spark):
    d = spark.createDataFrame([(1, None, 0, "Email"), (2, "produce", 1, None)], "n int, o string, r int, m string")
    got = d.select(production.effective_disposition(F.lit(True), F.col("r") > 0, F.col("o"))).collect()
    assert [r[0] for r in got] == ["withhold", "produce"]
    big = spark.range(1).select(N.bates(F.lit("A"), F.lit(1234567), F.lit(6)), N.bates(F.lit("A"), F.lit(7), F.lit(6))).first()
    assert big[:] == ("A1234567", "A000007")


def test_families_stay_together_and_numbers_have_no_gaps(spark):
    rows = [("s", "C3", None, "b", 1, 2), ("s", "C1", "f", "z", 5, 1), ("s", "C4", "f", "a", 2, 3), ("s", "C2", None, None, None, 1)]
    d = spark.createDataFrame(rows, "set_id string, control string, family_id string, custodian string, doc_date int, pages long")
    by = lambda flag: [r["control"] for r in production.ordered(d, flag).orderBy("sort_order").collect()]
    assert by(False) == ["C1", "C4", "C2", "C3"] and by(True) == ["C2", "C3", "C1", "C4"]
    n = production.numbered(production.ordered(d), "P", 3, 9).orderBy("sort_order").collect()
    assert [(r["begin"], r["end"]) for r in n] == [("P009", "P009"), ("P010", "P012"), ("P013", "P013"), ("P014", "P015")]


def test_load_file_round_trip(spark):
    rows = spark.createDataFrame([("þBEGþ\x14þNOTEþ",), ("þA1þ\x14þx\\yþ",), ("",), ("þA2þ",)], "value string")
    path = files.write_text(rows, ordered=True)
    assert sorted(map(tuple, files.read_load_file(spark, path, slashes=True).collect())) == [("A1", "x/y"), ("A2", "")]


def test_archives_and_office_files():
    assert [(n, s) for _, n, s, _ in files._zip_rows("a", files.sample_zip())] == [("a.txt", 5), ("deep.txt", 4)]
    got = {n: files.extract_one(n, b) for n, b in files.sample_office_files()}
    assert got["a.docx"] == ("ok", "Hello world") and got["a.txt"] == ("ok", "déjà") and got["a.exe"][0] == "unsupported" and "Plain" in got["a.rtf"][1]


def test_hash_groups_ignore_empty_hashes(spark):
    d = spark.createDataFrame([(1, "x"), (2, "x"), (3, ""), (4, ""), (5, None), (6, "y")], "doc_id long, sha256 string")
    assert sorted(map(tuple, dedup.hash_groups(d).collect())) == [(1, 1), (2, 1)]


def test_spread_and_choice_of_k():
    assert clustering.spread(10, 4) == [0, 3, 6, 9] and clustering.spread(3, 5) == [0, 1, 2] and clustering.spread(9, 1) == [0]
