"""What grows with the input is not broadcast, however small Spark takes it to be."""

import pytest

from fieldmarch.llm import lines, links, mixing, near_copies
from fieldmarch.session import cut


def broadcasts(plan):
    """The subtrees of a plan that are broadcast."""
    rows = [(len(r) - len(r.lstrip(" :+-")), r.lstrip(" :+-")) for r in plan.splitlines()]
    for i, (depth, node) in enumerate(rows):
        if node.startswith("BroadcastExchange"):
            inside = []
            for at, below in rows[i + 1 :]:
                if at <= depth:
                    break
                inside.append(below)
            yield "\n".join(inside)


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that are written, by their columns."""
    seen = []

    def kept(df):
        seen.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return cut(df)

    for module in (lines, links, mixing, near_copies):
        monkeypatch.setattr(module, "cut", kept)
    return seen


def documents(spark):
    words = [f"w{i % 7}x{i % 11} w{i}" for i in range(60)]
    texts = [(i, " ".join(words[i % 5 : 40 + i % 5]), f"s{i % 3}") for i in range(40)]
    return spark.createDataFrame(texts, "doc_id long, text string, source string").repartition(2)


def test_exploded_keys_and_texts_are_not_broadcast(spark, plans):
    got = near_copies.near_copies(cut(documents(spark)), 4, 80)
    assert got.count() == 40
    assert any(columns == ["key", "cls", "pivot", "members"] for columns, _ in plans)
    for _, plan in plans:
        for part in broadcasts(plan):
            # 36 rows a class, sized as one
            assert "explode" not in part or "sequence" in part, part
            assert "text#" not in part, part


def test_tables_of_documents_and_lines_are_not_broadcast(spark, plans):
    docs = cut(documents(spark))
    assert mixing.mix(docs).count() == 40
    assert lines.fuzzy_lines(docs).count() == 40
    assert any("number" in columns for columns, _ in plans) and any("first_line" in columns for columns, _ in plans)
    for _, plan in plans:
        for part in broadcasts(plan):
            # a document's place, a cell of the histogram, a line of a document: rows as they are, not summed up
            assert "Aggregate" in part or not any(f"{c}#" in part for c in ("number", "bucket", "line")), part


def test_sources_without_number_are_not_broadcast(spark, plans, monkeypatch):
    docs = cut(documents(spark))
    few = {(r.doc_id, r.copies) for r in mixing.mix(docs).collect()}
    del plans[:]
    monkeypatch.setattr(mixing, "FEW", 1)
    assert {(r.doc_id, r.copies) for r in mixing.mix(docs).collect()} == few
    assert not [p for columns, p in plans if "copies" in columns and "number" in columns for part in broadcasts(p) if "gap" in part or "Aggregate" in part]
