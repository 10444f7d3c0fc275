"""Width of op1's unit rows, which are stored and shuffled."""

from barloom.llm import units


def test_units_carry_one_key_beside_the_id(spark):
    rows = [(None, "one two. three four."), (None, "one two. five."), (None, "one two. five."), (3, "three four. one two."), (3, "one two.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = units.unit_rows(docs, unit="sentence", doc_id="doc_id", text="text")
    assert found.columns == ["key", "doc_id", "at", "start", "end", "n_words", "h1", "h2"]
    # rows without an id are told apart, equal ones share their key
    assert found.where("doc_id is null").select("key").distinct().count() == 2
    kept = [r["kept_text"] for r in units.drop_repeated_units(docs, unit="sentence").collect()]
    assert sorted(t.strip() for k in kept for t in k.split(".") if t.strip()) == ["five", "one two", "three four"]
