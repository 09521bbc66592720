"""Leaks by row: ids that are missing or repeat, and items whose parts stand far apart."""

from tapeloom.llm import decontaminate

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota? kappa lambda mu nu xi omicron pi rho sigma."


def test_rows_that_share_an_id(spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    rows = [(None, f"so {ITEM}"), (None, "clean without an id"), (7, f"well {ITEM}"), (7, "clean with an id that repeats"), (8, None), (None, None), (9, f"so {ITEM}")]
    kept = decontaminate.drop_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [r for r in rows if not r[1] or "clean" in r[1]]))


def test_parts_that_stand_far_apart(spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    question, answer = decontaminate.question_and_answer(ITEM)
    filler = " ".join(f"f{i}" for i in range(1000))
    halves = ITEM.split(" ")
    rows = [(1, f"{question} {filler} {answer}"), (2, f"{answer} {filler} {question}"), (3, f"{question} {filler}"), (4, f"{' '.join(halves[:3])} {filler} {' '.join(halves[3:])}")]
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench, overlap=0.7).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 4} and all(r["score"] >= 0.5 and r["overlap"] >= 0.7 for r in got)
