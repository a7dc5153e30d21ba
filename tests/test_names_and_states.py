"""Communities, joins of names and observations against plain Python."""

import random
from datetime import datetime, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import communities as K
from corpusmill.operators import names, observation
from corpusmill.streaming.observation import observed


def quality(edges, part):
    total = sum(w for *_, w in edges)
    degree = {}
    for a, b, w in edges:
        for x in (a, b):
            degree[part[x]] = degree.get(part[x], 0) + w
    return sum(w for a, b, w in edges if part[a] == part[b]) / total - sum(k * k for k in degree.values()) / (2 * total) ** 2


def best(edges):
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})

    def parts(i, labels):
        if i == len(nodes):
            yield dict(zip(nodes, labels, strict=True))
            return
        for k in range(max(labels, default=-1) + 2):
            yield from parts(i + 1, [*labels, k])

    return max(quality(edges, p) for p in parts(0, []))


def test_communities_are_near_the_best_modularity(spark):
    draw = random.Random(4)
    cliques = [(a + 4 * g, b + 4 * g, 1) for g in (0, 1) for a, b in combinations(range(4), 2)] + [(3, 4, 1)]
    weighted = [(a, b, draw.randint(1, 4)) for a, b in combinations(range(8), 2) if draw.random() < 0.4] + [(2, 2, 1)]
    for edges, share in ((cliques, 1.0), (weighted, 0.8)):  # the second ends in a local optimum
        df = spark.createDataFrame([*edges, (None, 1, 1)], "a long, b long, w long")
        found = K.communities(df, rounds=6, levels=2)
        part = {r["node"]: r["community"] for r in found.collect()}
        assert part.keys() == {x for a, b, _ in edges for x in (a, b)} and all(c == min(n for n, d in part.items() if d == c) for c in part.values())
        assert abs(K.modularity(df, found) - quality(edges, part)) < 1e-9
        assert quality(edges, part) >= share * best(edges) - 1e-9
    assert K.communities(spark.createDataFrame([], "a long, b long, w long")).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("least", [0.51, 0.7, 0.85])
def test_alike_names_are_all_found(spark, least):
    draw, words = random.Random(9), ["", "a", "ab", "abc"]
    for _ in range(90):
        w = list(draw.choice(words))
        for _ in range(draw.randint(0, 3)):
            k = draw.randint(0, len(w))
            w[k : k + draw.randint(0, 1)] = draw.choices("abcé", k=draw.randint(0, 3))
        words.append("".join(w))
    rows = [(i, w, "xy"[i % 2]) for i, w in enumerate(words)] + [(1000, None, "x"), (1001, "abc", None)]
    out = names.alike_names(spark.createDataFrame(rows, "id long, name string, kind string"), ["kind"], least).collect()
    want = {}
    for (a, s, k), (b, t, m) in combinations(rows, 2):
        if k == m and k and s is not None and t is not None:
            score = round(1 - edits(s, t) / max(len(s), len(t)), 6) if s or t else 1.0
            if score >= least:
                want[a, b] = score
    assert {(r["a"], r["b"]): r["score"] for r in out} == want and len(out) == len(want) > 50


def test_no_plan_joins_on_the_block_alone_or_crosses(spark, capsys):
    rows = spark.createDataFrame([(1, "abcdefgh", "x")], "id long, name string, kind string")
    names.alike_names(rows, ["kind"]).explain()
    names.containing(rows, rows).explain()
    plan = capsys.readouterr().out
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "piece" in plan and "gram" in plan


def test_containing(spark):
    draw = random.Random(2)
    word = lambda n: "".join(draw.choices("aAbcé ", k=n))
    texts = [(i, word(draw.randint(0, 25))) for i in range(120)] + [(500, None), (501, "")]
    needles = [(i, word(draw.randint(1, 5))) for i in range(60)] + [(70, ""), (71, None), (72, "zzz"), (73, "a")]
    frame = lambda rows: spark.createDataFrame(rows, "id long, name string")
    out = names.containing(frame(needles), frame(texts)).collect()
    want = {(i, j) for i, n in needles for j, t in texts if n and t is not None and n.lower() in t.lower()}
    assert {tuple(r) for r in out} == want and len(out) == len(want)
    assert names.containing(frame([(1, "")]), frame(texts)).count() == 0


def test_greedy_clusters_equal_the_loop(spark):
    draw = random.Random(6)
    titles = [(i, "".join(draw.choices("abcdefghijkl", k=draw.randint(0, 9)))) for i in range(260)] + [(400, None)]
    got = {r["at"]: r["leader"] for r in names.greedy_clusters(spark.createDataFrame(titles, "at long, title string")).collect()}
    leaders, want = [], {}
    for i, t in titles:
        s = set(t or "")
        want[i] = next((j for j, o in leaders if s and len(s & o) / len(s | o) >= 0.7), i)
        if want[i] == i:
            leaders.append((i, s))
    assert got == want


T0 = datetime(2024, 1, 1)


def a_log():
    draw, rows = random.Random(8), []
    for n in range(700):
        kind = draw.choices(["start", "rollback", "tick"], [2, 1, 90])[0]
        types = {t: draw.choice([0, 5, 30]) for t in "abc"}
        rows.append((draw.randrange(6), T0 + timedelta(hours=draw.randint(0, 24 * 30)), n, kind, draw.choice([0, 50, 80]), draw.choice([40, 60]), draw.choice([0.0, 0.02, 0.05, 0.2]), types))
    return rows


def machine(rows, now):
    out = {}
    for project in {r[0] for r in rows}:
        own, cur = sorted((r for r in rows if r[0] == project), key=lambda r: (r[1], r[2])), None

        def close(at, cur):
            if cur and cur["status"] != "rolled_back" and at >= cur["at"] + timedelta(days=7):
                cur["status"] = "expired"

        for r in own:
            close(r[1], cur)
            if r[3] == "start":
                cur = out[project, r[2]] = {"at": r[1], "base": r, "n": 0, "alerts": set(), "status": "active"}
            elif cur and r[3] == "rollback":
                cur["status"] = "rolled_back"
            elif cur and r[3] == "tick" and cur["status"] in ("active", "alert"):
                b = cur["base"]
                moved = lambda k: b[k] > 0 and abs(round((r[k] - b[k]) / b[k], 4)) > 0.5  # noqa: E731, B023
                a = {"entities"} if moved(4) else set()
                a |= {"relations"} if moved(5) else set()
                a |= {"ratio"} if (r[6] / b[6] > 2 if b[6] > 0.01 else r[6] > 0.1) else set()
                a |= {"types"} if b[4] > 0 and any(v >= 0.1 * b[4] and not r[7].get(t) for t, v in b[7].items()) else set()
                cur["n"] += 1
                cur["alerts"] |= a
                cur["status"] = "alert" if cur["alerts"] else "active"
        close(now, cur)
    return {k: (v["n"], sorted(v["alerts"]), v["status"]) for k, v in out.items()}


def test_observations_equal_the_machine(spark):
    rows, now = a_log(), T0 + timedelta(days=31)
    got = observation.observations(spark.createDataFrame(rows, observation.LOG), F.lit(now)).collect()
    want = machine(rows, now)
    assert {(r["project"], r["observation"]): (r["n_snapshots"], r["alerts"], r["status"]) for r in got} == want
    assert {s for *_, s in want.values()} == {"active", "alert", "expired", "rolled_back"}


def test_the_stream_ends_observations_by_timer_and_equals_the_batch(spark, tmp_path):
    rows = sorted(a_log(), key=lambda r: r[1])
    end = rows[-1][1] + timedelta(days=40)
    for k in range(0, len(rows), 100):
        spark.createDataFrame(rows[k : k + 100], observation.LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k:04d}")
    spark.createDataFrame([(99, end, 9999, "tick", 1, 1, 0.0, {})], observation.LOG).write.parquet(f"{tmp_path}/in/9998")
    spark.createDataFrame([(99, end, 10000, "tick", 1, 1, 0.0, {})], observation.LOG).write.parquet(f"{tmp_path}/in/9999")
    log = spark.readStream.schema(observation.LOG).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    last = {}

    def keep(batch, _):
        last.update({(r["project"], r["observation"]): (r["n_snapshots"], r["alerts"], r["status"]) for r in batch.collect()})

    query = observed(log).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert last == machine(rows, end)
