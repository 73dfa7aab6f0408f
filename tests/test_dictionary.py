"""Names in passages against a plain search."""

import random


from docweave.operators import dictionary


def test_names_against_plain_search(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcÄé-1 ") for _ in range(rnd.randrange(1, 9)))
    names = [(i, rnd.choice([None, "", word(), word(), word().upper()])) for i in range(120)]
    passages = [(i, rnd.choice([None, "", *["".join(word() for _ in range(rnd.randrange(1, 40)))] * 6])) for i in range(150)]
    passages.append((999, "x" * (dictionary.WINDOW - 2) + "needle" + "y" * 5000))
    names.append((999, "NEEDLE"))
    got = dictionary.named_in(spark.createDataFrame(names, "id long, name string"), spark.createDataFrame(passages, "passage long, content string")).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == {(i, p) for i, n in names if n for p, c in passages if c and n.lower() in c.lower()}
    assert (999, 999) in {tuple(r) for r in got}


def test_repeated_rows_and_empty_tables(spark):
    names, passages = spark.createDataFrame([(1, "ab"), (1, "ab"), (1, "b")], "id long, name string"), spark.createDataFrame([(7, "xabx"), (7, "xabx")], "passage long, content string")
    assert [tuple(r) for r in dictionary.named_in(names, passages).collect()] == [(1, 7)]
    assert dictionary.named_in(names.limit(0), passages).collect() == [] == dictionary.named_in(names, passages.limit(0)).collect()


def test_meetings_grow_with_hits(spark):
    """A name is looked up by its rarest letters: a common word in it meets nothing."""
    passages = spark.createDataFrame([(i, f"pump {'zq9x' if i == 5 else ''} running") for i in range(500)], "passage long, content string")
    got = dictionary.named_in(spark.createDataFrame([(1, "pump zq9x")], "id long, name string"), passages)
    assert [r.passage for r in got.collect()] == [5]


def test_owners(spark):
    passages = spark.createDataFrame([("d", 3, "about Pump"), ("d", 1, "intro"), ("d", 7, "pump again"), ("e", 2, "none")], "document string, chunk_index long, content string")
    names = spark.createDataFrame([(1, "pump"), (2, "valve")], "id long, name string")
    pairs = names.select("id").crossJoin(spark.createDataFrame([("d",), ("e",), ("f",)], "document string"))
    got = {(r.id, r.document): r.owner for r in dictionary.owners(pairs, names, passages).collect()}
    assert got == {(1, "d"): 3, (1, "e"): 2, (1, "f"): None, (2, "d"): 1, (2, "e"): 2, (2, "f"): None}


def test_no_list_of_all_names(spark):
    names, passages = spark.createDataFrame([(1, "ab")], "id long, name string"), spark.createDataFrame([(7, "xabx")], "passage long, content string")
    plan = dictionary.named_in(names, passages)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan and "Cross" not in plan


def test_names_are_computed_once_and_letters_found_by_a_pattern(spark, monkeypatch):
    """Groups of letters of passages come from one pattern, a letter beyond 16 bits too, and no later step computes the names again."""
    plans, plain = [], dictionary.cut
    monkeypatch.setattr(dictionary, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df))
    names = spark.range(3).selectExpr("id", "concat(repeat('\U0001f600', cast(id as int)), 'ab', id) as name")
    passages = spark.createDataFrame([(7, "x\U0001f600AB1\U0001f600\U0001f600ab2")], "passage long, content string")
    got = dictionary.named_in(names, passages)
    assert {tuple(r) for r in got.collect()} == {(1, 7), (2, 7)}
    assert "Range" in plans[0] and not any("Range" in p for p in [*plans[1:], got._jdf.queryExecution().optimizedPlan().toString()])
    assert "regexp_extract_all" in plans[1]
