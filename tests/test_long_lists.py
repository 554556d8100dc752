"""Ten thousand replacements in one rule: both evaluations against a plain loop."""

import random
import re

from tablewright.functions.text import replace_values
from tablewright.operators import recheck
from tablewright.plans import rules as R
from tablewright.plans.plan import Plan
from tablewright.runner import clean_table


def plainly(cell, mappings):
    for m in mappings if cell is not None else []:
        find, new, mode = m["find"], m["replace"], m.get("match", "exact")
        if mode == "exact" and cell.strip() == find:
            return new
        if mode == "contains" and find in cell:
            return None if new is None else cell.replace(find, new)
        if mode == "regex" and re.search(find, cell):
            return None if new is None else re.sub(find, new, cell)
    return cell


def make(n, seed=3):
    rng = random.Random(seed)
    mappings = []
    for i in range(n):
        mode = "regex" if i % 2500 == 1200 else ("exact", "exact", "contains")[rng.randrange(3)]
        find = f"^w{i % 97}[.]" if mode == "regex" else f"w{rng.randrange(n)}" + ("-" if mode == "contains" else "")
        mappings.append({"find": find, "replace": rng.choice([None, f"<{i}>", ""]), "match": mode})
    cells = [None, "", "  ", " w5 ", "w12-w13-", "w1200.x", "no"]
    cells += [f"{' ' * rng.randrange(2)}w{rng.randrange(2 * n)}{rng.choice(['', '-', '- w3-', '.x', ' é'])}" for _ in range(600)]
    return mappings, cells


def test_ten_thousand_replacements_first_match_wins(spark):
    mappings, cells = make(10_000)
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "id int, cell string")
    got = {r.id: r.cell for r in df.select("id", replace_values(df.cell, mappings).alias("cell")).collect()}
    want = {i: plainly(c, mappings) for i, c in enumerate(cells)}
    assert got == want and sum(got[i] != c for i, c in enumerate(cells)) > 100  # a good part was replaced


def test_the_second_evaluation_agrees_and_a_run_is_valid(spark):
    mappings, cells = make(300, 4)
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "_row_id int, cell string")
    plan = Plan((R.trim_text("cell"), R.replace_values("cell", mappings))).approve()
    want = {i: plainly(None if c is None else c.strip(), mappings) for i, c in enumerate(cells)}
    assert {r._row_id: r.cell for r in recheck.evaluate(plan, df).collect()} == want
    assert clean_table(df, plan).validation.valid
