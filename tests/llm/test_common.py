"""What operators leave in the shared folder."""

import os

from cardloom.llm import common as C
from cardloom.llm.jaccard_join import jaccard_components
from cardloom.llm.line_dedup import dedup_lines
from cardloom.llm.sharding import shard


def test_discard(spark):
    kept, gone = C.written(spark.range(5), "kept"), C.written(spark.range(7), "gone")
    paths = [C._paths[t].removeprefix("file://") for t in (kept, gone)]
    assert [os.path.exists(p) for p in paths] == [True, True]
    C.discard(gone)
    assert [os.path.exists(p) for p in paths] == [True, False] and kept.count() == 5


def test_only_tables_that_the_result_reads_stay(spark, awkward, empty):
    folder = C.shared_dir(spark).removeprefix("file://")
    for docs in (awkward, empty):
        for operator, stay in ((jaccard_components, {"sets", "stars"}), (dedup_lines, {"deleted_lines"}), (shard, {"sharding"})):
            before = set(os.listdir(folder))
            rows = operator(docs)
            new = {p.rsplit("-", 1)[0] for p in set(os.listdir(folder)) - before}
            assert new == stay, operator
            assert rows.count() == docs.count()
