"""Hashed projections of maps: names that change, nulls, slices; weights worked out once a name."""

import pyarrow as pa

from brooklet.operators import projection
from brooklet.operators.projection import hashed_entries, hashed_weights


def test_maps_by_arrays(monkeypatch):
    rows = [[("a", 1.0), ("b", 2.5)], None, [], [("c", 4.0)], [("b", 1.0), ("a", None)], [("é", float("inf"))]] * 3
    maps, asked = pa.array(rows, pa.map_(pa.string(), pa.float64())), []
    monkeypatch.setattr(projection, "hashed_weights", lambda n, names: asked.extend(names) or hashed_weights(n, names))
    known = {}
    got = [*hashed_entries(maps.slice(0, 5), 7, known).to_pylist(), *hashed_entries(maps.slice(5), 7, known).to_pylist()]
    assert sorted(asked) == ["a", "b", "c", "é"]
    for row, out in zip(rows, got):
        if row is None:
            assert out is None
        elif any(v is None for _, v in row):
            assert out == [None] * 7
        else:
            plain = [0.0] * 7
            for name, v in row:
                plain = [s + v * w for s, w in zip(plain, hashed_weights(7, [name])[:, 0].tolist())]
            assert str(out) == str(plain)


def test_maps_in_frames(spark):
    df = spark.createDataFrame([(1, {"a": 1.0, "b": 2.0}), (2, None), (3, {"x": 4.0})], "k int, m map<string,double>")
    out = projection.stream_hash_map(df, "m", 5)
    assert out.columns == ["k", "m", *(f"p{i}" for i in range(5))] and out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    rows = {r.k: [r[f"p{i}"] for i in range(5)] for r in out.collect()}
    w = hashed_weights(5, ["a", "b", "x"])
    assert rows[1] == (w[:, 0] + 2 * w[:, 1]).tolist() and rows[2] == [None] * 5 and rows[3] == (4 * w[:, 2]).tolist()
