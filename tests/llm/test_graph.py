import random

from cinderglass.llm.graph import components, merged


def labels_of(df):
    return {r.node: r.component for r in df.collect()}


def test_merged_equals_components_of_all_links(spark):
    rng = random.Random(5)
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    old = [(rng.randrange(40), rng.randrange(40)) for _ in range(18)] + [(70, 71)]
    new = [(rng.randrange(60), rng.randrange(60)) for _ in range(14)] + [(71, 69), (3, 3), (None, 4)]
    assert labels_of(merged(components(frame(old)), frame(new))) == labels_of(components(frame(old + new)))
    assert labels_of(merged(components(frame(old)), frame([]))) == labels_of(components(frame(old)))
    assert labels_of(merged(components(frame([])), frame(new))) == labels_of(components(frame(new)))
