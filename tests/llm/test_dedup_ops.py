import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lexfold.llm import exact_dedup, jaccard_join, line_dedup
from tests.llm import data

WS = r"[\x20\x09-\x0D]"


def stored(df, tmp_path, name="documents"):
    path = str(tmp_path / f"{name}.parquet")
    df.coalesce(1).write.parquet(path)
    return path


def exact_brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(WS, "", r["text"] or "")].append(r)
    out = []
    for g in groups.values():
        key = lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0)
        keep = min(g, key=key)["doc_id"]
        out += [(r["doc_id"], keep, len(g), r["doc_id"] == keep) for r in g]
    return sorted(out, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_matches_brute_force(spark, tmp_path, weak):
    df = data.odd(spark).unionByName(data.frame(spark, [(i + 20, t, "en", "s", 0) for i, t in enumerate(["a b", "ab", "a  b", "ab c", "abc", "abd"])]))
    # a digest of two characters makes different texts collide: the byte check must part them
    digest = (lambda c: F.substring(c, 1, 2)) if weak else exact_dedup.sha256_hex
    got = exact_dedup.streaming_dedup(spark, stored(df, tmp_path), digest=digest).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got], key=str) == exact_brute(df.collect())


def test_exact_dedup_state_is_continued(spark, tmp_path):
    path = tmp_path / "documents.parquet"
    state = f"file://{tmp_path}/state"
    data.frame(spark, data.rows(["a", "b"])).coalesce(1).write.parquet(str(path))
    assert exact_dedup.streaming_dedup(spark, str(path), state).filter("group_size > 1").count() == 0
    data.frame(spark, [(9, "a ", "en", "s", 2)]).coalesce(1).write.mode("append").parquet(str(path))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.streaming_dedup(spark, str(path), state).collect()}
    assert got == {0: (9, 2), 9: (9, 2), 1: (1, 1)}


def test_exact_dedup_tells_when_seen_files_were_rewritten(spark, tmp_path):
    path, state = tmp_path / "documents.parquet", f"file://{tmp_path}/state"
    data.frame(spark, data.rows(["a", "a", "b"])).coalesce(1).write.parquet(str(path))
    exact_dedup.streaming_dedup(spark, str(path), state).count()
    data.frame(spark, data.rows(["a", "a", "b"])).coalesce(1).write.mode("overwrite").parquet(str(path))
    with pytest.raises(ValueError, match="begin a new state"):
        exact_dedup.streaming_dedup(spark, str(path), state)


@pytest.mark.parametrize("after", [["a new text", "b"], ["b", "b"], ["b", "a"], ["a"], ["a", "b", "c"]])
def test_exact_dedup_tells_when_single_rows_changed(spark, tmp_path, after):
    """A rewritten table never loses rows without an error, in groups of one too."""
    path, state = tmp_path / "documents.parquet", f"file://{tmp_path}/state"
    data.frame(spark, data.rows(["a", "b"])).coalesce(1).write.parquet(str(path))
    assert exact_dedup.streaming_dedup(spark, str(path), state).count() == 2
    file = next(x for x in path.iterdir() if x.suffix == ".parquet")
    again = tmp_path / "again.parquet"
    data.frame(spark, data.rows(after)).coalesce(1).write.parquet(str(again))
    for x in path.iterdir():
        x.unlink()
    file.write_bytes(next(x for x in again.iterdir() if x.suffix == ".parquet").read_bytes())
    with pytest.raises(ValueError, match="begin a new state"):
        exact_dedup.streaming_dedup(spark, str(path), state)


def test_exact_dedup_empty_and_clashing_columns(spark, tmp_path):
    empty = data.frame(spark, [])
    assert exact_dedup.streaming_dedup(spark, stored(empty, tmp_path, "e")).count() == 0
    clash = data.frame(spark, data.rows(["a", "a"])).withColumns({"digest": F.lit(1), "n": F.lit(2), "keep_id": F.lit(3)})
    assert exact_dedup.streaming_dedup(spark, stored(clash, tmp_path, "c")).filter("kept").count() == 1


def line_brute(texts):
    """texts in order of documents; windows of three lines with words, later ones covered."""
    seen, out = set(), []
    for t in texts:
        lines = (t or "").split("\n")
        at = [i for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        covered = set()
        for p in range(len(at) - 2):
            k = tuple(lines[i].strip(" \t\n\x0b\f\r") for i in at[p : p + 3])
            if k in seen:
                covered |= {p, p + 1, p + 2}
            seen.add(k)
        unit = [max(sum(a <= i for a in at) - 1, 0) for i in range(len(lines))]
        out.append((len(at), len(covered), t if not covered else "\n".join(x for x, u in zip(lines, unit) if u not in covered)))
    return out


def test_line_dedup_matches_brute_force(spark):
    texts = ["a\nb\nc\nd\ne", "x\n\na\nb\n\nc\nd\ny", "a\nb", "q\nq\nq\nq\nq\nq", "\n\na\n b \nc\n\n", "c\nd\ne\nf", "", None, "q\nq\nq", "r\n" * 3000]
    rows, name = line_dedup.dedup_lines(data.frame(spark, data.rows(texts)))
    got = [(r[name]["n_lines"], r[name]["n_removed"], r["text"]) for r in rows.orderBy("doc_id").collect()]
    assert got == line_brute(texts)


def test_line_dedup_odd_rows_and_columns(spark):
    df = data.odd(spark).withColumns({"line_dedup": F.lit("mine"), "p": F.lit(1), "d": F.lit(2)})
    rows, name = line_dedup.dedup_lines(df)
    assert name == "line_dedup_" and rows.count() == df.count() and rows.drop(name).columns == df.columns
    assert line_dedup.dedup_lines(df.limit(0))[0].count() == 0
    twice = data.frame(spark, [(1, "a\nb\nc", "en", "s", 5)] * 2 + [(None, "a\nb\nc", "en", "s", 5)])
    out = {(r["doc_id"], r["text"]) for r in line_dedup.drop_repeated_lines(spark, twice, "").collect()}
    assert out == {(1, "a\nb\nc")}  # wholly equal rows are one document; the null id comes last


def shingle_sets(texts):
    out = []
    for t in texts:
        w = [x for x in re.split(WS + "+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) if x]
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def jaccard_brute(ids, texts):
    sets = shingle_sets(texts)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same = ids[i] == ids[j] and ids[i] is not None and sets[i] and sets[j]
            if same or (both and 100 * both >= 75 * len(sets[i] | sets[j])):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    lowest = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted([(ids[i], len(sets[i]), lowest[find(i)]) for i in range(len(ids))], key=str)


@pytest.mark.parametrize(("small", "slack", "block", "scheme"), [(16, 0.06, 1000, None), (2, 0.06, 1000, 0), (2, 0.0, 5, 1), (2, 0.0, 1000, 2), (1, 0.0, 7, 2)])
def test_jaccard_join_matches_brute_force(spark, monkeypatch, small, slack, block, scheme):
    """Small limits send the same groups through anchors, left-out signatures and the comparison beyond the slack."""
    monkeypatch.setattr(jaccard_join, "SMALL_GROUP", small)
    monkeypatch.setattr(jaccard_join, "SLACK", slack)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "FILLED", 16)
    if scheme is not None:
        monkeypatch.setattr(jaccard_join, "least_cost", lambda measured: (dict.fromkeys(range(40), scheme), 0))
    texts = data.near_copies(seed=small)
    got = jaccard_join.similar_groups(data.frame(spark, data.rows(texts)), shards=3).collect()
    assert sorted([tuple(r) for r in got], key=str) == jaccard_brute(list(range(len(texts))), texts)


def test_jaccard_join_odd_rows(spark):
    df = data.odd(spark)
    rows = df.collect()
    got = jaccard_join.similar_groups(df, shards=2).collect()
    assert sorted([tuple(r) for r in got], key=str) == jaccard_brute([r["doc_id"] for r in rows], [r["text"] for r in rows])
    assert jaccard_join.similar_groups(df.limit(0), shards=2).count() == 0


def test_word_hashes_agree_with_words():
    import pyarrow as pa

    texts = ["A b\tc", "", "a  B\x0b", "é É", "x" * 300 + " y", "\n"]
    h, n = jaccard_join.word_hashes(pa.array(texts))
    assert n.tolist() == [3, 0, 2, 2, 2, 0]
    assert h[0] == h[3] and h[1] == h[4] and h[5] != h[6] and len(Counter(h.tolist())) == 7


def test_op1_sql_agrees(spark, tmp_path):
    df = data.odd(spark).filter("doc_id IS NOT NULL")
    path = stored(df, tmp_path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.sql(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({exact_dedup.OP1_SQL})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in exact_dedup.streaming_dedup(spark, path).collect())
