"""Settings from files, and the rules in them."""

from linkledger.operators import rules
from linkledger.sources import settings as S

TEXT = """{"download_path": " ~/x ", "courses": [], "sync": null, "course_folders": {" A* ": " a ", "": "b", "c": " "}, "subfolder_destinations": {"A/B": "~/y"}, "section_folder_names": null}"""


def test_defaults_and_trimming():
    got = S.settings(S.parsed(TEXT))
    assert got["courses"] == ["*"] and got["sync"] is True and got["course_folders"] == {"A*": "a"} and got["section_folder_names"] == {}
    assert not got["download_path"].startswith("~") and got["download_path"].endswith("/x") and got["subfolder_destinations"]["A/B"].endswith("/y")
    assert S.settings(S.parsed("")) == S.settings({}) and S.settings({})["download_path"] == "./downloads"


def test_saved_settings_are_read_back(tmp_path):
    path = str(tmp_path / "config")
    one, two = S.settings(S.parsed(TEXT)), S.settings({"courses": ["Analysis"]})
    S.save(one, path)
    S.save(two, path)
    assert S.load(path) == two and S.load(f"{path}.bak") == one


def test_rules_become_a_table(spark):
    table = S.rules_of(spark, S.settings(S.parsed(TEXT)))
    assert {(r["kind"], r["pattern"]) for r in table.collect()} == {("course_folder", "A*"), ("destination", "A/B"), ("course", "*")}
    assert rules.problems(table).collect() == []
