"""First rows of a data set of many files: the right ones, and no file behind them read."""

import json
import os

import pytest

from loomcraft.sources import scans

# Files by name and what they hold; one is empty.
FILES = {"a 1": [0, 1, 2], "b+2": [3], "c": [], "d": [4, 5, 6, 7], "e": [8, 9], "f": [10]}


def save(spark, folder, fmt):
    os.makedirs(folder)
    for name, ids in FILES.items():
        path = f"{folder}/{name}.{fmt}"
        if fmt == "parquet":
            import pyarrow as pa
            import pyarrow.parquet as pq
            pq.write_table(pa.table({"id": pa.array(ids, pa.int64())}), path, row_group_size=2)
        else:
            with open(path, "w") as f:
                f.write(json.dumps([{"id": i} for i in ids]) if fmt == "json_array" else "".join(f'{{"id": {i}}}\n' for i in ids))


@pytest.mark.parametrize("fmt", ["parquet", "json", "json_array"])
def test_first_rows_of_every_length(spark, tmp_path, fmt):
    folder = f"{tmp_path}/{fmt}"
    save(spark, folder, fmt)
    for n in (0, 1, 3, 4, 6, 8, 10, 11, 12):
        assert sorted(r.id for r in scans.scan_dataset(spark, folder, fmt, num_samples=n).collect()) == list(range(min(n, 11))), n


def test_files_behind_are_not_read(spark, tmp_path):
    folder = f"{tmp_path}/cut"
    save(spark, folder, "parquet")
    with open(f"{folder}/z.parquet", "w") as f:
        f.write("no Parquet at all")
    assert sorted(r.id for r in scans.scan_dataset(spark, folder, num_samples=2).collect()) == [0, 1]
    assert sorted(r.id for r in scans.scan_dataset(spark, folder, num_samples=4).collect()) == [0, 1, 2, 3]


def test_first_tasks_of_a_curriculum(spark, tmp_path):
    os.makedirs(f"{tmp_path}/c")
    for name, tasks in (("a.csv", ["one\nline", "two"]), ("b.csv", ["three"]), ("c.csv", ["four"])):
        with open(f"{tmp_path}/c/{name}", "w") as f:
            f.write("Category,SubCategory,Task\n" + "".join(f'c,s,"{t}"\n' for t in tasks))
    for n, want in ((0, []), (1, ["one\nline"]), (3, ["one\nline", "two", "three"]), (9, ["one\nline", "two", "three", "four"])):
        rows = scans.scan_curriculum(spark, f"{tmp_path}/c", n).collect()
        assert [r.Task for r in sorted(rows, key=lambda r: r.ordinal)] == want
        assert sorted(r.ordinal for r in rows) == list(range(len(want)))
