from test_operators import frame

from lodestone.llm import contamination


def test_occurrences_of_short_items_are_cut(spark):
    benchmark = spark.createDataFrame([(1, "seven or fewer words"), (2, "secret"), (3, "one two three four five six seven eight nine")], "item_id bigint, text string")
    rows = [(1, "before Seven, or fewer words after"), (2, "a secret, b"), (3, "Secret!"), (4, "x one two three four five six seven eight y"), (5, "secret: seven or fewer words"), (6, "seven words")]
    for item in (benchmark, benchmark.unionByName(benchmark)):
        found = {r.doc_id: r.text for r in contamination.clean(frame(spark, rows), item).collect()}
        assert found == {1: "before  after", 2: "a , b", 4: "x  y", 6: "seven words"}
