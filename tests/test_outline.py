"""Headings, checks, terms, reports and rosters of small documents."""

import random


from foliant.operators import outline as O


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_paths_equal_a_stack(spark):
    r = random.Random(2)
    texts = ["\n".join(r.choice(["#" * r.randint(1, 7) + f" t{r.randint(0, 9)}", "text", "", "#no"]) for _ in range(r.randint(1, 30))) for _ in range(60)]
    want = {}
    for i, text in enumerate(texts):
        stack = []
        for n, line in enumerate(text.split("\n"), 1):
            level = len(line) - len(line.lstrip("#"))
            if 1 <= level <= 6 and line[level : level + 1] == " ":
                stack = [x for x in stack if x[0] < level] + [(level, line[level:].strip())]
            want[i, n] = [t for _, t in stack]
    assert {(x.doc_id, x.line): x.path for x in O.outline(frame(spark, *texts, None)).where("doc_id < 60").collect()} == want


def test_checks_are_numbered_and_problems_have_lines(spark):
    text = "- stray\n# List\n## One\n- first\n  2) second\ntext\n### deeper\n* third\n## Empty\n## Two\n1. only"
    got = sorted((x.line, x.number, x.title, x.check, x.problem) for x in O.checks(frame(spark, text, None)).collect())
    assert got == [
        (1, None, None, "stray", "item outside of chapters"), (4, "1.1", "One", "first", None), (5, "1.2", "One", "second", None), (8, "1.3", "One", "third", None),
        (9, None, "Empty", None, "chapter without items"), (11, "3.1", "Two", "only", None),
    ]


def test_terms_and_their_problems(spark):
    text = "# Terms\n### early (string)\nwords\n## Money\n### cap (number)\nThe\n\n cap.\n### basis (enum: pre | post |)\nHow.\n### cap (number)\nx\n### Bad Name\ny\n### kind (thing)\nz\n### list (enum list)\nz\n## Other\n### bare (boolean)\n# End\nnot guidance"
    got = [(x.line, x.name, x.kind, x.members, x.grp, x.guidance, x.problem) for x in O.terms(frame(spark, text)).orderBy("line").collect()]
    assert got[:3] == [(2, "early", "string", [], "", "words", None), (5, "cap", "number", [], "Money", "The cap.", None), (9, "basis", "enum", ["pre", "post"], "Money", "How.", None)]
    assert [(x[0], x[6]) for x in got[3:]] == [(11, "name came before"), (13, "malformed heading"), (15, "unknown type"), (17, "enum without members"), (20, "no guidance")]


def test_reports(spark):
    text = "# R\nProposed action:  decline \nProposed action: no\n## Eligibility\nintro\n1. one\n   more\n\n- sub\n2.  two\n## Other\n1. not this\n## Missing\n7. three"
    docs = frame(spark, text, "nothing", None)
    got = sorted((x.section, x.nth, x.item) for x in O.report_items(docs, ["Eligibility", "Missing"]).collect())
    assert got == [("Eligibility", 1, "one\n   more\n- sub"), ("Eligibility", 2, "two"), ("Missing", 1, "three")]
    assert {x.doc_id: x.action for x in O.proposed_action(docs).collect()} == {0: "decline", 1: None, 2: None}


def test_rosters(spark):
    text = "# People\nhttps://www.linkedin.com/in/Ann-Lee/\n| x | y |\n| Full name | LinkedIn_ID | Email addresses |\n|---|---|---|\n| Ann | https://linkedin.com/in/ann-lee | |\n| Bob |  | B@x.com, b@x.com |\n| Bob again | | b@x.com |\n| Cy | cy 1 | |\n| | | |\n| Dee | | |\n| Dee | | |"
    got = [(x.line, x.full_name, x.profile, x.emails) for x in O.rosters(frame(spark, text, None, "| a | b |")).orderBy("line").collect()]
    assert got == [(2, "", "ann-lee", []), (7, "Bob", "", ["b@x.com"]), (9, "Cy", "cy-1", []), (11, "Dee", "", [])]
