import __spark_entry__ as entry
from quillspark.plans import queries as core


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(core.QUERIES) >= 40 and set(core.ORACLES) <= set(core.QUERIES)


def test_core_does_not_import_the_optional_part():
    import pathlib

    root = pathlib.Path(core.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p
