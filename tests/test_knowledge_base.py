import json
from datetime import datetime

import pytest

from marginalia.knowledge_base import KnowledgeBase
from marginalia.sinks import formats


def test_life_of_a_knowledge_base(spark, tmp_path):
    kb = KnowledgeBase(spark, f"file://{tmp_path}/kb")
    assert kb.notes.count() == 0 and kb.search("anything").count() == 0
    at = datetime(2026, 4, 28, 10, 0, 0)
    a, missing = kb.add("Spark plans queries [[nothing yet]]", "Spark", "permanent", ["engine"], at=at)
    assert missing == ["nothing yet"] and a == "202604281000000000"
    b, missing = kb.add("Graphs of notes, see [[spark]]", "Graphs", "permanent", ["engine", "graph"], at=at)
    c, _ = kb.add("soup and bread", template="quick", at=at)
    assert not missing and {a, b, c} == {"202604281000000000", "202604281000000001", "202604281000000002"}
    notes = {r["id"]: r for r in kb.notes.collect()}
    assert notes[a]["backlinks"] == [b] and notes[b]["links"] == [a] and notes[c]["type"] == "fleeting" and notes[c]["tags"] == ["fleeting"]
    assert kb.search("graphs notes").first()["id"] == b
    assert [r["id"] for r in kb.search("graphs notes", mode="semantic", tags=["graph"]).collect()] == [b]
    assert {r["id"] for r in kb.search("spark", mode="keyword", note_type="permanent").collect()} <= {a, b}
    assert kb.query("graphs notes", 1).first()["neighbors"] == 1
    assert kb.show("Graphs").first()["id"] == b and kb.refs(part="graph").first()["outgoing"] == 1 and kb.refs("Graphs").first()["other"] == a
    assert kb.related("Spark", 1).first()["id"] == b and kb.orphans().first()["id"] == c and kb.graph_stats().first()["edges"] == 1
    assert "Graphs" in kb.draw("Spark") and kb.daily("2026-04-28").count() == 3 and kb.inbox().first()["id"] == c
    assert kb.verify().first()["healthy"] and kb.index_status().first()["vectors"] == 3
    assert kb.suggest("a text on spark queries and plans").count() >= 1
    kb.edit(b, content="no links now", title="Trees")
    notes = {r["id"]: r for r in kb.notes.collect()}
    assert notes[a]["backlinks"] == [] and notes[b]["title"] == "Trees" and notes[b]["updated"] > notes[a]["updated"]
    with pytest.raises(KeyError):
        kb.edit("1", title="x")
    kb.delete([a])
    assert kb.notes.count() == 2 and kb.index.docs.count() == 2 and kb.vectors.count() == 2
    (tmp_path / "in.json").write_text(json.dumps([{"title": "t", "content": "bulk words", "tags": ["x"]}] * 2))
    assert kb.import_json(f"file://{tmp_path}/in.json") == 2 and kb.status().filter("type is null").first()["notes"] == 4
    assert kb.export_markdown(f"file://{tmp_path}/out") == 4
    other = KnowledgeBase(spark, f"file://{tmp_path}/other")
    assert other.import_markdown(f"file://{tmp_path}/out").count() == 0 and other.notes.count() == 4
    assert formats.render(other.list().drop("links", "backlinks"), "tree").startswith("notes/")
    other.reindex()
    assert KnowledgeBase(spark, f"file://{tmp_path}/other").notes.count() == 4
