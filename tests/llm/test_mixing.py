from collections import Counter, defaultdict

import pytest

from sliceforge.llm.mixing import given_weights, long_schedule, mix_sources, period_schedule, tempered_weights

from .conftest import edge_rows


def test_schedule_meets_all_deadlines(spark):
    df = spark.createDataFrame([("a", 70), ("b", 20), ("c", 9), ("d", 1), (None, 3)], "source string, n long")
    docs = df.selectExpr("source", "explode(sequence(1L, n)) AS doc_id")
    weights = given_weights(docs, {"a": 50, "b": 31, "c": 15, "d": 3, None: 1})
    rows = sorted(period_schedule(weights).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(100))
    done = Counter()
    for r in rows:
        k, w = done[r["source_key"]], r["w"]
        assert k == r["place"]
        assert k * 100 // w <= r["slot"] < -(-(k + 1) * 100 // w)
        done[r["source_key"]] += 1
        for key, w in {x["source_key"]: x["w"] for x in rows}.items():
            assert abs(done[key] - w * (r["slot"] + 1) / 100) < 1


def test_long_schedule_meets_all_windows(spark):
    given = {"a": 50, "b": 31, "c": 15, "d": 3, "e": 1, "f": 27}
    docs = spark.createDataFrame([(s, i) for i, s in enumerate(given)], "source string, doc_id long")
    rows = long_schedule(given_weights(docs, given), 127).collect()
    assert sorted(r["slot"] for r in rows) == list(range(127))
    for r in rows:
        assert r["place"] * 127 // r["w"] <= r["slot"] < -(-(r["place"] + 1) * 127 // r["w"])


def test_many_uneven_sources(spark):
    sizes = {f"s{i}": 1 + i % 9 for i in range(2300)}
    docs = spark.createDataFrame(list(sizes.items()), "source string, n long")
    docs = docs.selectExpr("source", "explode(sequence(1L, n)) AS nth").selectExpr("source", "hash(source) * 10L + nth AS doc_id")
    rows = mix_sources(docs, block_docs=2).collect()
    assert Counter(r["source"] for r in rows) == sizes
    total = sum(n**0.5 for n in sizes.values())
    taken = {}
    for r in rows:
        m, share = r["mix"], sizes[r["source"]] ** 0.5 / total
        assert abs(m["source_weight"] / m["period"] / share - 1) < 1 / 32
        assert m["release"] == m["block"] * m["period"] // m["source_weight"]
        assert m["release"] <= m["slot"] < m["deadline"]
        assert taken.setdefault(m["slot"], (r["source"], m["block"])) == (r["source"], m["block"])


def test_every_row_is_placed_once(edge_docs):
    rows = mix_sources(edge_docs, block_docs=4).collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in rows) == Counter((i, t, s) for i, t, _, s in edge_rows())
    assert set(edge_docs.columns) == set(rows[0].asDict())
    places = [(r["mix"]["slot"], r["mix"]["place"]) for r in rows]
    assert len(set(places)) == len(places)
    blocks = defaultdict(set)
    for r in rows:
        m = r["mix"]
        blocks[r["source"], m["block"]].add(m["slot"])
        assert m["release"] <= m["slot"] < m["deadline"]
    assert all(len(s) == 1 for s in blocks.values())
    assert {s for s, _ in blocks} == {None, "", "a", "b", "c", "hot"}  # null is no empty name


def test_repeat_keeps_every_row_and_the_weights(edge_docs):
    rows = mix_sources(edge_docs, tempered_weights(edge_docs, alpha=0.3), block_docs=2, exhausted="repeat").collect()
    assert {(r["doc_id"], r["text"]) for r in rows} == {(i, t) for i, t, *_ in edge_rows()}
    slots = {(r["source"], r["mix"]["slot"]) for r in rows}
    horizon = max(s for _, s in slots) + 1
    share = Counter(s for s, _ in slots)
    for r in rows:
        assert abs(share[r["source"]] - horizon * r["mix"]["source_weight"] / r["mix"]["period"]) < 1


def test_stop_ends_where_a_source_ends(edge_docs):
    full = mix_sources(edge_docs, block_docs=2).collect()
    part = mix_sources(edge_docs, block_docs=2, exhausted="stop").collect()
    assert 0 < len(part) < len(full)
    used = sorted({r["mix"]["slot"] for r in part})
    assert used == list(range(len(used)))


def test_empty_table_and_wrong_weights(edge_docs, no_docs):
    assert mix_sources(no_docs).count() == 0
    assert mix_sources(no_docs, exhausted="repeat").count() == 0
    with pytest.raises(Exception, match="no weight for source"):
        mix_sources(edge_docs, given_weights(edge_docs, {"a": 1})).collect()


def by_hand(given):
    """Slots by the rule: of the released blocks that of the earliest deadline, then
    of the earliest release, then of the source that comes first."""
    period, done, out = sum(given.values()), dict.fromkeys(sorted(given), 0), []
    for t in range(period):
        ready = [(-(-(k + 1) * period // given[s]), k * period // given[s], s) for s, k in done.items() if k < given[s] and k * period // given[s] <= t]
        s = min(ready)[2]
        out.append((t, s, done[s]))
        done[s] += 1
    return out


@pytest.mark.parametrize("given", [{"a": 3, "b": 5, "c": 2}, {"a": 7, "b": 7, "c": 3, "d": 3}, {"a": 1, "b": 1, "c": 1, "d": 9}, {"a": 50, "b": 31, "c": 15, "d": 3, "e": 1}])
def test_both_schedules_give_the_same_slots(spark, given):
    docs = spark.createDataFrame([(s, i) for i, s in enumerate(given)], "source string, doc_id long")
    weights = given_weights(docs, given)
    want = by_hand(given)
    for rows in (period_schedule(weights).collect(), long_schedule(weights, sum(given.values())).collect()):
        assert sorted((r["slot"], r["source_key"][1:], r["place"]) for r in rows) == want


def test_the_sql_on_a_table_with_a_rare_source(spark, tmp_path):
    import duckdb

    from sliceforge.llm.oracle import OP2

    rows = [(i, "hot" if i < 4000 else f"s{i % 3}" if i < 4300 else "rare") for i in range(4301)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    assert tempered_weights(docs).agg({"w": "sum"}).first()[0] > 1100  # the period grows with the rare source
    got = sorted((r["doc_id"], r["mix"]["slot"], r["mix"]["place"]) for r in mix_sources(docs).collect())
    con = duckdb.connect()
    docs.toPandas().to_parquet(tmp_path / "d.parquet")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet'")
    assert sorted(con.sql(f"SELECT doc_id, slot, place FROM ({OP2})").fetchall()) == got
