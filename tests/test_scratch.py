import os

from ingestctl.scratch import materialise, shared_folder, working_folder


def test_a_working_folder_is_removed_and_other_tables_stay(spark):
    kept = materialise(spark.range(3).toDF("v"), "kept")
    with working_folder(spark) as folder:
        made = materialise(kept, "made")
        assert made.count() == 3 and os.listdir(folder)
        with working_folder(spark) as inner:
            assert inner.startswith(folder) and materialise(made, "deeper").count() == 3
        assert not os.path.exists(inner)
    assert not os.path.exists(folder)
    assert kept.count() == 3
    assert materialise(kept, "after").inputFiles()[0].replace("file://", "").startswith(shared_folder(spark))
