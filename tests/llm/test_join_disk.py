"""What the near-duplicate join leaves on disk and sends through its last shuffle."""

import time

from docquery.llm import common, jaccard_join


def stored_blocks(spark) -> int:
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().size()


def test_a_stage_leaves_no_shuffle_files(spark):
    before = stored_blocks(spark)
    made = common.staged(spark.range(1000).repartition(7), "shuffled")
    until = time.time() + 20
    while stored_blocks(spark) > before and time.time() < until:
        time.sleep(0.2)
    assert stored_blocks(spark) <= before
    assert made.count() == 1000
    assert spark.conf.get(common.DROP_SHUFFLES, "false") == "false"


def test_lists_of_the_same_nodes_bring_their_sets_once(spark, monkeypatch):
    words = [f"word{k}" for k in range(120)]
    texts = {1: words, 2: [*words[:-1], "other"], 3: ["before", *words], 4: [f"else{k}" for k in range(50)]}
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    seen, compared = [], jaccard_join.blocks.compared

    def counted(rows, *args, **kwargs):
        seen.append(rows.count())
        return compared(rows, *args, **kwargs)

    monkeypatch.setattr(jaccard_join.blocks, "compared", counted)
    monkeypatch.setattr(jaccard_join, "OPEN_PER_ROW", 1 << 40)  # the first round compares all pairs
    monkeypatch.setattr(jaccard_join.blocks, "CELL_ROWS", 1)  # so lists lie in many cells
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4}
    assert seen[0] > 40 and seen[1] <= 9  # many lists, of at most three different groups of nodes
