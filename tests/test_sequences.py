"""Sequences cut into parts: running values, load-file breaks, volumes, samples, dates."""

import datetime
import random
from email.utils import parsedate_to_datetime

import pytest
from pyspark.sql import functions as F

from lexfold.functions import normalize as N
from lexfold.operators import clustering as K
from lexfold.operators import production as O
from lexfold.operators import ranks
from lexfold.operators import rollover as R
from lexfold.plans.registry import QUERIES
from lexfold.session import importable
from lexfold.sources import files as X


@pytest.fixture
def many_parts(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield importable(spark)
    for k, v in before.items():
        spark.conf.set(k, v)


def test_running_values_over_many_parts(many_parts):
    r = random.Random(2)
    rows = [(r.choice("ab"), i, r.choice([None, r.randrange(100)])) for i in range(700)]
    df = many_parts.createDataFrame(r.sample(rows, len(rows)), "g string, i int, x long")
    for how, start, step in (("sum", None, lambda s, x: s if x is None else (s or 0) + x), ("max", None, lambda s, x: x if s is None else s if x is None else max(s, x)), ("last", None, lambda s, x: s if x is None else x)):
        state, want = {}, {}
        for g, i, x in rows:
            state[g] = step(state.get(g, start), x)
            want[i] = state[g]
        assert {q.i: q.v for q in ranks.scan(df, ["g"], ["i"], "v", F.col("x"), how).collect()} == want
        down, back = None, {}
        for _, i, x in reversed(rows):
            down = step(down, x)
            back[i] = down
        assert {q.i: q.v for q in ranks.scan(df, [], [F.desc("i")], "v", F.col("x"), how).collect()} == back


def opticon(lines):
    docs, name, pages = {}, None, []
    for line in lines:
        f = line.split(",")
        if len(f) < 4:
            continue
        if f[3].strip().upper() == "Y":
            if name and pages:
                docs[name] = pages
            name, pages = f[0].strip(), [f[2].strip().replace("\\", "/")]
        else:
            pages.append(f[2].strip().replace("\\", "/"))
    if name and pages:
        docs[name] = pages
    return docs


def test_opticon_over_many_parts(many_parts):
    r = random.Random(4)
    lines = [f"D{r.randrange(120)},V,img\\{i}.tif,{r.choice(['', '', '', 'Y', ' y'])},,," if r.random() > 0.05 else "short,line" for i in range(600)]
    lines[:3] = ["X,V,lost\\1.tif,,,,", "X,V,lost\\2.tif,,,,", "D1,V,a.tif,Y,,,"]
    df = many_parts.createDataFrame(r.sample(list(enumerate(lines)), len(lines)), "line_no long, value string").repartition(50)
    parsed = X.parse_opticon(df)
    assert {p.bates: p.pages for p in parsed.collect()} == opticon(lines)


def dealt(rows, cap):
    out, state = {}, {}
    for s, o, size in sorted(rows):
        volume, used = state.get(s, (1, 0))
        if used > 0 and used + (size or 0) > cap:
            volume, used = volume + 1, 0
        state[s] = (volume, used + (size or 0))
        out[s, o] = volume
    return out


@pytest.mark.parametrize("seed, cap", [(1, 100), (2, 30), (3, 1), (4, 10**6)])
def test_volumes_equal_the_greedy_loop(many_parts, seed, cap):
    r = random.Random(seed)
    rows = [(s, f"D{i:05d}", r.choice([0, 0, None, 1, r.randrange(60), cap, cap + r.randrange(50)])) for s in (1, 2) for i in range(250)] + [(3, "D0", 0), (3, "D1", None), (4, "D0", cap * 5), (4, "D1", 0), (4, "D2", 0), (4, "D3", 1)]
    df = many_parts.createDataFrame(rows, "s int, o string, size long")
    got = R.volumes(df, "s", "o", "size", cap)
    assert {(g.s, g.o): g.volume for g in got.collect()} == dealt(rows, cap)
    totals = {}
    for (s, o), v in dealt(rows, cap).items():
        t = totals.setdefault((s, f"VOL{v:03d}"), [0, 0])
        t[0] += 1
        t[1] += next(x or 0 for a, b, x in rows if (a, b) == (s, o))
    assert {(m.s, m.label): [m.documents, m.bytes] for m in R.manifest(got, "s", "size").collect()} == totals


def test_no_volumes(spark):
    assert R.volumes(importable(spark).createDataFrame([], "s int, o string, size long"), "s", "o", "size", 5).collect() == []


def test_native_production_takes_one_page(spark):
    rows = [("produce", "a.MP4", 9), (None, "b/c.msg", 9), ("withhold", "a.mp4", 9), ("redact_in_part", "a.mp4", 9), (None, None, 9), (None, "a.pdf", 9), (None, "noext", 0)]
    d = spark.createDataFrame(rows, "d string, n string, p int")
    native = O.produced_as_native(F.col("d"), F.col("n"), ("mp4", "msg"))
    assert [tuple(r) for r in d.select(native, O.produced_pages(F.col("d"), F.col("p"), native)).collect()] == [(True, 1), (True, 1), (False, 1), (False, 9), (False, 9), (False, 9), (False, 1)]
    assert not any(r[0] for r in d.select(O.produced_as_native(F.col("d"), F.col("n"), ())).collect())


def test_diverse_sample_takes_unused_vectors(spark):
    v = importable(spark).createDataFrame([(i, [float(i % 3), 0.0]) for i in range(30)], "id long, v array<float>")
    got = K.diverse(v, 5).collect()
    assert len({g.id for g in got}) == 5 and {g.cluster for g in got} == set(range(5)) and {g.id % 3 for g in got} == {0, 1, 2}
    assert len(K.diverse(v.limit(2), 5).collect()) == 2 and K.diverse(v.limit(0), 5).collect() == []


def test_dates(spark):
    mail = ["Mon, 20 Jul 2026 14:30:00 GMT", "Mon, 20 Jul 2026 14:30:00 +0000 (UTC)", "20 Jul 2026 14:30:00", "Mon, 20 Jul 26 14:30 EDT", "20-Jul-2026 14:30:00 -0730", "1 January 1970 00:00:00 PST", "Tue, 1 Feb 70 03:04:05 +0100 (a) (b)", "3 Mar 2020 10:00:00 XYZ", "Fri, 13 Sep 2024 23:59:59 -0000"]
    none = ["31 Feb 2024 10:00:00", "20 Jul 2026", "soon", "", "  ", "20 Foo 2026 10:00:00 GMT"]
    iso = {"2024-01-02T10:00:00+02:00": "2024-01-02 08:00", "2024-01-02T10:00:00Z": "2024-01-02 10:00", "2024-01-02T10:00:00-0330": "2024-01-02 13:30", " 1/2/2024 3:04 PM ": "2024-01-02 15:04", "2024-01-02": "2024-01-02 00:00"}
    got = {r.v: r.t for r in spark.createDataFrame([(v,) for v in [*mail, *none, *iso]], "v string").select("v", F.unix_timestamp(N.utc_of(F.col("v"))).alias("t")).collect()}
    utc = datetime.timezone.utc
    for v in mail:
        t = parsedate_to_datetime(v)
        assert got[v] == (t if t.tzinfo else t.replace(tzinfo=utc)).timestamp(), v
    assert all(got[v] is None for v in none)
    assert all(got[v] == datetime.datetime.fromisoformat(t).replace(tzinfo=utc).timestamp() for v, t in iso.items())


def test_a_date_is_read_once(spark):
    v = F.concat(F.col("v"), F.lit(""))  # stands for any expression
    d = spark.createDataFrame([("20 Jul 26 14:30 EDT\n",), ("Mon, 20 Jul 2026 14:30:00 -0730 (a|b) (c/d)",), ("1|20|Jul|2026|14|30|0|",), ("13/2/2024",), ("2024-02-30",), (None,)], "v string")
    got = d.select(F.unix_timestamp(N.utc_of(v)).alias("t"))
    at = lambda *x: datetime.datetime(*x, tzinfo=datetime.timezone.utc).timestamp()
    assert [r.t for r in got.collect()] == [at(2026, 7, 20, 18, 30), at(2026, 7, 20, 22, 0), None, None, None, None]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(v") <= 1 and plan.count("regexp_extract") == 0 and plan.count(r"\([^()]*\)") == 1


def test_dates_are_dealt_over_all_tasks(spark):
    d = QUERIES["n4_normalize_date"](spark, "/root/testdata/sf0.001")
    assert d.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
