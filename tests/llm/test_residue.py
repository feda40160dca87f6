from codeloom.llm.residue import mine, residue_documents
from tests.conftest import rows

BASE = "The limit of 42 matches protects the ferry job from running out of memory."
YES = ["# {{ title }}\n", "Seite nicht gefunden", "You need to enable JavaScript to run this app.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "test test test test test", "Owner: None", "Dear ,\n\nyour report is ready.", "Intro.\n\n## Scope\n\nYour session has expired. Please sign in again.", BASE.replace("42", "<COUNT_HERE>"), "We own this rule ([insert owner here]).", '{"error": {"code": 504}}', "Loading...", "502 Bad Gateway"]
NO = ["", "  \n", "Templates may use `{{ name }}` here.", 'The page only says "Loading...".', "```html\n<h1>{{ title }}</h1>\n```", "A 502 Bad Gateway from the mirror is retried twice.", "See [OWNERS](docs/owners.md) and note [3].", "- [x] done\n- [ ] open", "Usage: audit scan <path> [OPTIONS]", "The route /rules/{rule_id}/history asks for a login.", "In the settings file ${HOME} stands for the home folder.", "A missing owner is exported as null, never as text.", "Filler such as lorem ipsum is rejected.", "The field accepts dates as yyyy-mm-dd.", BASE]


def test_texts(spark):
    data = [(i, t) for i, t in enumerate(YES)] + [(100 + i, t) for i, t in enumerate(NO)] + [(200, None), (0, YES[0]), (300 + 0, BASE + " x" * 50_000)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("doc_id", "text", "'c' AS verdict", "1 AS message")
    got = {r.doc_id for r in residue_documents(df).select("doc_id").collect()}
    assert got == set(range(len(YES)))
    assert residue_documents(df.limit(0)).count() == 0


def test_template_decides_about_a_placeholder(spark):
    data = [(i, f"Write the {w} in the format of the marker") for i, w in enumerate(["red", "blue", "green", "old", "new"])] + [(9, "Write the [OWNER] in the format of the marker"), (10, "Write {{ owner }} in the head of a template")]
    got = rows(residue_documents(spark.createDataFrame(data, "doc_id bigint, text string")))
    assert got == [(9, "slot")]


def test_mining():
    t = mine([x.split() for x in ("a b c d", "a b x d", "q r s t")])
    assert t[0] == t[1] == ["a", "b", "<*>", "d"] and t[2] == ["q", "r", "s", "t"]


def test_a_leaf_in_parts_gives_what_it_gives_whole(spark):
    from codeloom.llm import residue as R

    data = [(i, f"Your session of the {chr(97 + i % 26)}{chr(97 + i // 26)} user is still in use today") for i in range(200)]
    data += [(999, "Your session has expired."), (998, "Your session of the {{ name }} user is still in use today")]
    found = spark.createDataFrame(data, "doc_id bigint, text string").mapInArrow(R._explode, R.MESSAGES)
    one, many = (rows(R.template_verdicts(found, parts=k)) for k in (1, 64))
    assert one == many and sorted(v for _, v, _ in one) == ["error", "slot"]
    assert {t for _, v, t in one if v == "slot"} == {"Your session of the <*> user is still in use today"}


def test_mining_takes_time_in_proportion():
    import random
    import time

    from codeloom.llm.residue import Leaf

    r = random.Random(1)
    word = lambda: f"w{r.randrange(50)}"
    spent = []
    for n in (2_000, 8_000):
        leaf = Leaf(12, 0.7)
        texts = [["a", "b", *[word() for _ in range(10)]] for _ in range(n)]
        began = time.process_time()
        for t in texts:
            leaf.add(t)
        spent.append(time.process_time() - began)
        assert len(leaf.templates) > 0.9 * n
    assert spent[1] < 10 * spent[0]  # quadratic would be 16 times


def test_bodies_are_read_as_a_whole():
    from codeloom.llm.residue import classify, messages, slot_verdict

    def verdicts(text):
        return {v if (v := classify(m.split())) != "ordinary" or not kind else slot_verdict(m.split(), m.split()) for kind, m in messages(text)}

    for text in ('{"status":503,"error":"upstream"}', '{"errors":[{"code": 1}]}', '{"message":"Access denied"}', '{"data": {"fault": {"faultstring": "x"}}}', '{"error": {"code": 504}}', "<Error><Code>AccessDenied</Code></Error>"):
        assert verdicts(text) == {"error"}, text
    for text in ('{"count": {{n}}}', '{"name": "{{ name }}", "size": 3}', '{"list": ["a", "{{ b }}"]}'):
        assert verdicts(text) == {"slot"}, text
    for text in ('{"error": null, "rows": 4}', '{"message": "Saved the list", "size": 3}', '{"name": "error", "errors": []}', '{"a": {}}', "{\"open"):
        assert verdicts(text) == {"ordinary"}, text
