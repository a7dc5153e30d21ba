"""A paged source as a batch and as a stream that is stopped, fails and starts again."""

import json
import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle

from corpusmill.operators import vectors
from corpusmill.sources.paged import paged_source

SCHEMA = "doc_id long, text string"
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the source's process has no tests folder


class Folder:
    """Pages as files 1.json, 2.json, ..."""

    def __init__(self, folder):
        self.folder = str(folder)

    def newest(self):
        return len(list(Path(self.folder).glob("*.json")))

    def rows(self, page):
        for doc, text in json.loads(Path(self.folder, f"{page}.json").read_text()):
            if text == "broken":
                raise OSError("the service is down")
            yield doc, text


@pytest.fixture
def given(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60).collect()
    return [(r["doc_id"], r["text"]) for r in rows]


def put(folder, page, rows):
    Path(folder, f"{page}.json").write_text(json.dumps(rows))


def test_batch_reads_all_pages_or_those_since(spark, given, tmp_path):
    for k in range(6):
        put(tmp_path, k + 1, given[10 * k : 10 * k + 10])
    spark.dataSource.register(paged_source("folder_batch", SCHEMA, Folder(tmp_path)))
    df = spark.read.format("folder_batch").option("pages", 2).load()
    assert sorted(map(tuple, df.collect())) == sorted(given) and df.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, spark.read.format("folder_batch").option("since", 4).load().collect())) == sorted(given[40:])


def test_a_stream_that_starts_again_loses_and_repeats_nothing(spark, given, tmp_path):
    pages, out, state = tmp_path / "pages", tmp_path / "out", tmp_path / "state"
    pages.mkdir()
    spark.dataSource.register(paged_source("folder_stream", SCHEMA, Folder(pages)))

    def run():
        source = spark.readStream.format("folder_stream").option("pages", 1).load()
        query = source.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).trigger(availableNow=True).start()
        query.awaitTermination()

    def seen():
        return sorted(map(tuple, spark.read.parquet(str(out)).collect()))

    put(pages, 1, given[:10])
    put(pages, 2, given[10:20])
    run()
    assert seen() == sorted(given[:20])
    run()  # nothing new
    assert seen() == sorted(given[:20])
    put(pages, 3, given[20:40])
    put(pages, 4, [(1, "broken")])
    with pytest.raises(Exception, match="down"):
        run()
    assert seen() == sorted(given[:20])
    put(pages, 4, given[40:60])
    run()
    assert seen() == sorted(given)


def test_alike_vectors_are_all_found(spark):
    import numpy as np

    draw = np.random.default_rng(3)
    base = draw.normal(size=(20, 6))
    rows = [(i, "xyz"[i % 3], [float(x) for x in base[i % 20] + 0.3 * draw.normal(size=6)]) for i in range(300)] + [(900, "x", None), (901, "x", [0.0] * 6), (902, None, [1.0] * 6), (903, "x", [1.0])]
    rows += [(1000 + k, "x", rows[3][2]) for k in range(40)] + [(1100, "y", rows[3][2])]
    df = spark.createDataFrame(rows, "id long, kind string, vector array<double>")
    first = {}
    for i, k, v in rows:
        first.setdefault((k, str(v)), i)
    unit = {i: (k, np.array(v) / np.linalg.norm(v)) for i, k, v in rows if k and v and len(v) == 6 and any(v) and first[k, str(v)] == i}
    for least in (0.92, 0.5):
        got = vectors.alike_vectors(df, "kind", least, n_lists=9, guarded=spark.createDataFrame([("z",)], "kind string")).collect()
        want = {(i, j) for i, (k, u) in unit.items() for j, (m, v) in unit.items() if i < j and k == m != "z" and round(float(u @ v), 6) >= least} | {(3, 1000 + k) for k in range(40)}
        assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want) > 100
    assert vectors.alike_vectors(df.limit(0), "kind").count() == 0
