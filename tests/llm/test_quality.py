import re

from molgrid.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit.update(range(i, i + 5))
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def test_edge_rows(edge_docs, edge_rows, no_docs):
    rows = [(d, t) for d, t in edge_rows if t is None or len(t) < 4000]
    got = quality.report(edge_docs).where("doc_id is null or doc_id not in (7, 8)").collect()
    assert sorted(((r.doc_id, *tuple(r)[1:7]) for r in got), key=repr) == sorted(((d, *brute(t)) for d, t in rows), key=repr)
    assert quality.report(no_docs).count() == 0


def test_line_rules(spark):
    good = "This is a sentence of more than ten words that ends as it should end."
    rows = [
        (1, good + "\n" + "Another sentence of this text stands on its own line here."),
        (2, "\n".join(["Home | News | Sport | Weather | Contact | Imprint | About | Search | Login | Help.", good[:20] + "."])),
        (3, "WORDS!! IN!! CAPITALS!! ONLY!! ARE!! NOT!! WHAT!! WE!! WANT!! TO!! KEEP!! HERE!!"),
        (4, "these### words$$$ have%%% many&&& symbols*** between### them$$$ and%%% after&&& them*** all###."),
        (5, "one two three four five six seven eight nine ten " * 5),
        (6, good + "\n" + good + "\n" + good),
        (7, good + "\nPrivacy policy.\nAll rights reserved."),
    ]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].kept for k in range(1, 8)] == [True, False, False, False, False, False, True]
    assert got[7].clean_text == good and got[5].base_failed


def test_plan_is_one_native_projection(edge_docs):
    plan = quality.report(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
