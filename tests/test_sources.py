from __future__ import annotations

import pytest

from sievelight.functions import MatrixMeta
from sievelight.sources import generators, matrix_market, reports, word_vectors


def put(tmp_path, text, name="m.mtx"):
    p = tmp_path / name
    p.write_text(text)
    return f"file://{p}"


def entries(df):
    return sorted(map(tuple, df.collect()))


GENERAL = "%%MatrixMarket matrix coordinate real general\n% a remark\n\n3 4 3\n1 1 0.5\n3 4 -2\n2 2 1e1\n"


def test_general(spark, tmp_path):
    m, shape = matrix_market.read(spark, put(tmp_path, GENERAL))
    assert shape == MatrixMeta(3, 4, 3) and entries(m) == [(0, 0, 0.5), (1, 1, 10.0), (2, 3, -2.0)]


@pytest.mark.parametrize("symmetry,sign", [("symmetric", 1), ("skew-symmetric", -1)])
def test_mirrored_by_banner(spark, tmp_path, symmetry, sign):
    text = f"%%MatrixMarket matrix coordinate real {symmetry}\n3 3 2\n2 1 5\n3 3 1\n"
    m, _ = matrix_market.read(spark, put(tmp_path, text))
    assert entries(m) == [(0, 1, 5.0 * sign), (1, 0, 5.0), (2, 2, 1.0)]
    assert len(entries(matrix_market.read(spark, put(tmp_path, text), direction="as_is")[0])) == 2


def test_pattern_loops_and_repeats(spark, tmp_path):
    path = put(tmp_path, "%%MatrixMarket matrix coordinate pattern general\n3 3 4\n1 1\n1 2\n1 2\n3 1\n")
    assert entries(matrix_market.read(spark, path)[0]) == [(0, 0, 1.0), (0, 1, 2.0), (2, 0, 1.0)]
    assert entries(matrix_market.read(spark, path, drop_loops=True, dedupe=None)[0]) == [(0, 1, 1.0), (0, 1, 1.0), (2, 0, 1.0)]


def test_graph(spark, tmp_path):
    path = put(tmp_path, "%%MatrixMarket matrix coordinate pattern general\n3 3 5\n1 1\n1 2\n1 2\n1 3\n3 1\n")
    assert entries(matrix_market.read_graph(spark, path)) == [(0, 1, 0.5), (0, 2, 0.5), (2, 0, 1.0)]
    assert entries(matrix_market.read_graph(spark, path, directed=False)) == [(0, 1, 0.5), (0, 2, 0.5), (1, 0, 1.0), (2, 0, 1.0)]


def test_ids_out_of_range(spark, tmp_path):
    path = put(tmp_path, "%%MatrixMarket matrix coordinate real general\n2 2 1\n1 3 1\n")
    with pytest.raises(Exception, match="outside"):
        matrix_market.read(spark, path)[0].collect()


@pytest.mark.parametrize(
    "lines,reason",
    [([], "empty"), (["%%Matrix"], "banner"), (["%%MatrixMarket matrix coordinate real odd"], "type"), (["%%MatrixMarket matrix array real general", "2 2"], "unsupported"), (["%%MatrixMarket matrix coordinate real general"], "size"), (["%%MatrixMarket matrix coordinate real general", "a b c"], "size")],
)
def test_faulty_headers(lines, reason):
    with pytest.raises(matrix_market.MatrixMarketError) as e:
        matrix_market.parse_header(lines)
    assert e.value.reason == reason


def test_word_vectors_with_and_without_count(spark, tmp_path):
    for head in ("", "2 3\n"):
        path = put(tmp_path, f"{head}the 1 2 3\nof -1 0.5 0\n", "v.txt")
        got = word_vectors.read(spark, path).orderBy("row_id").collect()
        assert [(r["row_id"], r["token"], r["embedding"]) for r in got] == [(0, "the", [1, 2, 3]), (1, "of", [-1, 0.5, 0])]


def test_column_files(spark, tmp_path):
    paths = [put(tmp_path, "\n".join(map(str, x)) + "\n", f"{i}.txt") for i, x in enumerate(([5.0, 6.0, 7.0], [0, 2, 2, 3], [0, 2, 1]))]
    got = reports.read_column_files(spark, *paths)
    assert entries(got) == [(0, 0, 5.0), (1, 2, 7.0), (2, 0, 6.0)]


def test_report(spark, tmp_path):
    reports.write_report(spark.createDataFrame([(1, [1.5, 2.0])], "run int, t array<double>"), f"file://{tmp_path}/r")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/r").first()["t"] == "1.5;2.0"


def test_generators_repeat_themselves(spark):
    for make in (lambda: generators.sparse(spark, 50, 20, 6, "gamma", seed=9), lambda: generators.masked(spark, 20, 10, 0.3, "normal", 9), lambda: generators.queries(spark, 3, 20, 0.5, 9)):
        assert entries(make()) == entries(make().repartition(3)) and entries(make())
    norms = generators.sparse(spark, 50, 20, 6, seed=9).selectExpr("row_id", "val * val v").groupBy("row_id").sum("v").collect()
    assert len(norms) == 50 and all(abs(r[1] - 1) < 1e-9 for r in norms)
