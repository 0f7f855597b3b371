import json
import os

import pytest

from rillstone import jobs
from rillstone.__main__ import main
from rillstone.sources import lines, markdown


def put(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_capture(spark, tmp_path):
    good = {"event_id": "e", "record_id": "r", "session_id": "s", "logical_seq": 1, "timestamp": "2026-01-01T00:00:00Z", "sender": "owner", "record_type": "message", "text": "ü"}
    raw = put(tmp_path / "raw.jsonl", good, "", "{")
    code, said = jobs.capture_raw(spark, raw, "s1", "cap/raw.jsonl", str(tmp_path / "b"))
    assert (code, said["occurrences"]) == (0, 3) and '"\\u00fc"' in (tmp_path / "b" / "events.jsonl").read_text()
    code, said = jobs.capture_raw(spark, raw, "bad stream", "cap/raw.jsonl", str(tmp_path / "c"))
    assert code == 2 and not os.path.exists(tmp_path / "c")
    code, _ = jobs.capture_prebuilt(spark, str(tmp_path / "b" / "occurrences.jsonl"), str(tmp_path / "d"))
    assert code == 0 and (tmp_path / "d" / "events.jsonl").read_bytes() == (tmp_path / "b" / "events.jsonl").read_bytes()
    assert jobs.load_canonical_events(spark, str(tmp_path / "b" / "events.jsonl")).count() == 1
    assert jobs.capture_prebuilt(spark, put(tmp_path / "x.jsonl", "{"), str(tmp_path / "e"))[0] == 2


def test_strict_and_tolerant_reading(spark, tmp_path):
    good = {"event_id": "e", "record_id": "r", "session_id": "s", "logical_seq": 1, "timestamp": "2026-01-01T00:00:00Z", "sender": "owner", "record_type": "message", "text": "x"}
    jobs.capture_raw(spark, put(tmp_path / "raw.jsonl", good), "s1", "cap/raw.jsonl", str(tmp_path / "b"))
    event, line = (tmp_path / "b" / "events.jsonl").read_text().strip(), (tmp_path / "b" / "occurrences.jsonl").read_text().strip()
    for bad in (event[:-1] + ',"event_id":"e2"}', event[:-1] + ',"more":1}', event + " x", event.replace('"actor":"owner",', "")):
        with pytest.raises(Exception, match="no event"):
            jobs.load_canonical_events(spark, put(tmp_path / "e.jsonl", bad))
    for bad in (line[:-1] + ',"line_number":1}', line[:-1] + ',"more":1}', line + " x", line[:-1] + ',"fixture_id":"f"}'):
        assert jobs.capture_prebuilt(spark, put(tmp_path / "o.jsonl", bad), str(tmp_path / "z"))[0] == 2
    (tmp_path / "t.jsonl").write_bytes(b'{"a":"x\xffy"}\n{"a":1} x\n\n[1]\n')
    got = sorted((r["line_number"], r["reason"], "\ufffd" in r["line"]) for r in lines.tolerant_records(spark, str(tmp_path / "t.jsonl")).collect())
    assert got == [(1, None, True), (2, "parse_error", False), (4, "non_object", False)]
    (tmp_path / "n.md").write_bytes(b"## Prompts\n1. one \xff two\n")
    assert [r["text"] for r in markdown.prompts(markdown.markdown_files(spark, str(tmp_path / "n.md"))).collect()] == ["one \ufffd two"]


def test_export_threads_and_query(spark, tmp_path):
    talk = {"uuid": "u", "updated_at": "2026-07-02", "chat_messages": [{"sender": "human", "text": "hi"}]}
    code, said = jobs.convert_export(spark, put(tmp_path / "x.json", [talk, talk | {"updated_at": "2026-06-01"}, talk | {"uuid": "v", "chat_messages": []}, 5]), str(tmp_path / "out"), "2026-07-01")
    assert code == 0 and (said["conversations_total"], said["conversations_written"], said["conversations_before_min_date"], said["conversations_zero_human"], said["conversations_malformed"]) == (4, 1, 1, 1, 1)
    catalog = put(tmp_path / "c.jsonl", {"slug": "a", "session_id": "1", "date": "2026-07-01", "goals": [{"goal": "Consolidate storage rules", "verdict": "met"}], "handoff": "h.md"}, {"slug": "b", "open_threads": 2, "open_text": "consolidate the storage rules"}, "broken", "[]")
    registry = put(tmp_path / "r.json", {"assignments": {"k": {"slug": "a", "topic": "store"}, "z": {"slug": "gone", "topic": "x"}}})
    code, said = jobs.build_threads(spark, catalog, registry, None, str(tmp_path / "t.md"), str(tmp_path / "t.jsonl"))
    assert (said["rows"], said["conflicts"], said["skipped"]) == (2, 2, {"parse_error": 1, "non_object": 1})
    assert "## store" in (tmp_path / "t.md").read_text() and "handoff=h.md" in (tmp_path / "t.jsonl").read_text()
    code, said = jobs.query_threads(spark, str(tmp_path / "t.jsonl"), "storage")
    assert said["hits"] == 2 and said["table"].count("\n") == 3
    assert jobs.query_threads(spark, str(tmp_path / "t.jsonl"), "quantum")[1]["table"] == "NO-MATCH"


def test_prompt_clusters(spark, tmp_path):
    d = tmp_path / "p"
    d.mkdir()
    for name in "abc":
        put(d / f"{name}.md", "## Prompts", "1. rebuild the broken index now", "2. rebuild the broken index", f"3. lonely {name * 5} words {name * 7} {name * 9}", "4. 123 /x")
    code, said = jobs.cluster_prompts(spark, str(d), str(tmp_path / "r.md"))
    assert (said["files"], said["prompts"], said["clusters"], said["unclustered_percent"]) == (3, 12, 2, 25.0)
    text = (tmp_path / "r.md").read_text()
    assert "- score: 27.00" in text and "- size: 6" in text and text.endswith("UNCLUSTERED: 25.0%\n")


def test_recurrence(spark, tmp_path):
    ask = "repair the broken importer module before release"
    catalog = put(tmp_path / "c.jsonl", {"slug": "a", "session_id": "1", "date": "2026-07-05", "entry_source": "close", "goals": [{"goal": ask, "verdict": "met"}], "friction": [{"what": "could not repair importer module, broken before release", "ref": "rule_a"}]})
    prompts = put(tmp_path / "p.jsonl", {"session_id": "2", "timestamp": "2026-06-01T00:00", "text": ask + " please"}, {"session_id": "3", "timestamp": "2026-06-02T00:00", "text": ask.upper() + "  please"}, {"session_id": "4", "timestamp": "2026-06-02", "text": "<command-name>x</command-name>"}, "bad")
    (tmp_path / "m").mkdir()
    put(tmp_path / "m" / "a-rule.md", "SUPERSEDED by b")
    seeds = put(tmp_path / "s.json", {"imports": ["importer"], "none": ["zzz"]})
    code, said = jobs.map_recurrence(spark, catalog, str(tmp_path / "o.md"), prompts_path=prompts, memory_dir=str(tmp_path / "m"), seeds_path=seeds, require_early=True)
    assert code == 0 and (said["clusters"], said["spanning_threads"], said["early_records"], said["citation_problems"], said["seeded_threads"]) == (1, 1, 1, 1, 2)
    assert "met 2026-07-05, no recurrence since" in (tmp_path / "o.md").read_text()
    assert jobs.map_recurrence(spark, catalog, str(tmp_path / "o2.md"), require_early=True)[0] == 2


def test_census(spark, tmp_path):
    (tmp_path / "t" / "a").mkdir(parents=True)
    put(tmp_path / "t" / "a" / "f.txt", "x")
    put(tmp_path / "t" / "lonely.txt", "x")
    rules = put(tmp_path / "r.csv", "pattern,disposition,reason", "a,archive,dest=z", ".,keep-in-place,")
    code, said = jobs.take_census(spark, str(tmp_path / "t"), str(tmp_path / "o"), rules_csv=rules, assert_complete=True)
    assert code == 1 and said["first_unassigned"] == ["lonely.txt"] and said["rows"] == 4
    assert sorted(os.listdir(tmp_path / "o")) == ["census-summary.md", "census.csv", "warnings.csv"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "t").mkdir()
    assert main(["take-census", "--root", str(tmp_path / "t"), "--out", str(tmp_path / "o")]) == 0
    assert capsys.readouterr().out.startswith("SUMMARY: ")
