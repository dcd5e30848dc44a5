from schedlake.llm.decontamination import contaminated
from test_decontamination import ITEMS


def found(spark, docs, items):
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r.same_slots for r in contaminated(docs, items).collect()}


def test_copies_in_other_case_and_within_a_line(spark):
    items = [t for _, t in ITEMS if t and len(t.split()) >= 5] + ["Seven plus Two makes what number", "Name the capital of Peru"]
    docs = [form for t in items for form in (t.lower(), t.upper(), "as they said " + t, "as they said " + t.upper() + " and so on")]
    got = found(spark, docs, items)
    assert got == {(at, at // 4): True for at in range(len(docs))}


def test_other_parameters(spark):
    items = ["What is 12 + 7 * 3 - 5", "Ann has 3 apples and 4 pears and she eats 2 of them, how many fruits are left?", "Add up 1 2 3 4 5 6 7 8 9 10 and tell me the sum"]
    docs = [
        "Question: What is 15 + 8 * 2 - 9", "He asked what is 15 + 8 * 2 - 9",
        "Ann has 5 apples and 5 pears and she eats 1 of them, how many fruits are left?",
        "Add up 9 9 7 6 5 4 3 2 1 11 and tell me the sum", "add up 9 8 7 6 5 4 3 2 1 11 and tell me the sum",
        "99 88 77 66 55 44 33 22 11 12 13 14 " * 3, "Sizes 3 1 4 1 5 9 2 6 5 3 5 8 9 7 9",
    ]
    assert found(spark, docs, items) == {(0, 0): False, (1, 0): False, (2, 1): False, (3, 2): False, (4, 2): False}
    assert found(spark, ["Ann has 5 apples and 5 pears, and Bob 6 apples"], ["Ann has 3 apples and 4 pears, and Bob 3 apples"]) == {}


def test_short_items_are_sought_as_texts_and_lines(spark):
    items = ["What is 3 + 4?", "Why?", "", "..."]
    docs = ["intro\n what IS 3 + 4 \nmore", "What is 3 - 4?", "what is 3 + 4 and 5", "WHY", "why not", "", "..."]
    assert found(spark, docs, items) == {(0, 0): True, (3, 1): True}
