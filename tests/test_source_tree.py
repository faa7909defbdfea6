"""How the tree of small files is written before it is read."""

from pathlib import Path

from workload import catalog_queries
from workload.registry import QUERIES


def test_files_are_written_by_several_tasks(spark, sf_dir, monkeypatch):
    roots = []
    read = catalog_queries.S.source_files

    def noted(session, root, *args, **kwargs):
        roots.append(root)
        return read(session, root, *args, **kwargs)

    monkeypatch.setattr(catalog_queries.S, "source_files", noted)
    n = QUERIES["S1_source_files"](spark, sf_dir).count()
    tasks = {p.name.split("-")[1] for p in Path(roots[0]).rglob("part-*")}
    assert n > 0 and len(tasks) > 1
