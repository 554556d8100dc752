import math

import numpy as np
import pytest

from tablewright.llm import pq
from tablewright.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows, bound=0.98):
    ok = {k: np.array(v, float) for k, v, lab in rows if v and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    of = {k: lab for k, _, lab in rows}
    links = {k: set() for k, _, _ in rows}
    for i in ok:
        for j in ok:
            a, b = ok[i], ok[j]
            if i != j and of[i] == of[j] and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= bound:
                links[i].add(j)
    out = {}
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out[k] = (len(links[k]), min(seen), min(seen) == k)
    return out


def vectors():
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        base = rng.normal(size=10)
        for _ in range(20):
            rows.append((len(rows), (base + rng.normal(size=10) * 0.12 * (c % 4)).astype(np.float32).tolist(), c % 3))
    t = 0.0
    for _ in range(40):  # a chain of links round half a circle
        rows.append((len(rows), [math.cos(t), math.sin(t)] + [0.0] * 8, 7))
        t += 0.15
    rows += [(len(rows) + i, rows[5][1], rows[5][2]) for i in range(30)]
    n = len(rows)
    rows += [
        (n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 10, 1), (n + 3, [float("nan")] + [1.0] * 9, 1), (n + 4, [None] + [1.0] * 9, 1),
        (n + 5, [float("inf")] + [1.0] * 9, 1), (n + 6, rows[0][1], None), (n + 7, [1.0, 2.0], 1), (n + 8, [2.0, 4.0], 1),
        (n + 9, [1e30] * 10, 2), (n + 10, [1e-30] * 10, 2), (n + 11, [0.0] + [1.0] * 9, 5), (n + 12, [-0.0] + [1.0] * 9, 5),
    ]
    return rows


@pytest.mark.parametrize("block", [pq.BLOCK, 7])
def test_query_against_brute_force(spark, write_tables, monkeypatch, block):
    monkeypatch.setattr(pq, "BLOCK", block)
    rows = vectors()
    got = QUERIES["op2_pq_near_dup"](spark, write_tables(embeddings=(rows, SCHEMA))).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_force(rows)


def test_whole_table_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in QUERIES["op2_pq_near_dup"](spark, folder).collect()}
    assert got == brute_force(rows)


def test_empty_table(spark, write_tables):
    assert QUERIES["op2_pq_near_dup"](spark, write_tables(embeddings=([], SCHEMA))).count() == 0


def test_estimates_pass_every_link_on():
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(600, 16))
    rows = np.concatenate([rows, rows[:300] + rng.normal(size=(300, 16)) * 0.04])
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    index = pq.fit(rows)
    cell, codes, error = pq.encode(rows, index)
    reach = math.sqrt(2 - 2 * 0.98) + 1e-6
    asked, probed = pq.probes(rows, index, reach)
    seen = set(zip(asked.tolist(), probed.tolist()))
    links = np.argwhere(np.triu(rows @ rows.T >= 0.98, 1))
    assert len(links) > 250
    for i, j in links:
        assert (i, cell[j]) in seen
        estimate = pq.lookups(rows[i : i + 1], index.centres[cell[j]], codes[j : j + 1], index)[0, 0]
        assert math.sqrt(max(0, estimate)) <= reach + error[j] + 1e-9
    assert len(seen) < len(rows) * len(index.centres)
