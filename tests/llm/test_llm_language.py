import numpy as np

from plainspeak.llm import language

TEXTS = {
    "de": "der hund und die katze laufen durch den wald und suchen ihren freund auf dem weg nach hause",
    "en": "the dog and the cat walk through the forest and look for their friend on the way home",
    "fr": "le chien et le chat marchent dans la foret et cherchent leur ami sur le chemin de la maison",
}


def documents(spark):
    rows = [(i, t, lang) for i, (lang, t) in enumerate(TEXTS.items())]
    return spark.createDataFrame([*rows, (9, "x", None), (None, "y", "en"), (10, None, "de")], "doc_id long, text string, lang string")


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", 1.0, "s") for r in rows], "page_id long, url string, html string, host string, p double, suffix string")


def page(text, lang=None):
    declared = f" lang='{lang}'" if lang else ""
    return f"<html{declared}><body><p>{text}</p></body></html>"


def test_trigram_counts():
    assert language.trigrams("abc").sum() == 3 and language.trigrams("").sum() == 0
    assert (language.trigrams("Ab, c!") == language.trigrams("ab c")).all()


def test_all_evidence_against_plain_arithmetic(spark):
    languages, model = language.fit(documents(spark))
    assert languages == ["de", "en", "fr"]
    rows = [(i, "http://a.de/x", page(TEXTS["de"], "de")) for i in range(6)]
    rows += [(10 + i, "http://b.com/x", page(TEXTS["en"], "en")) for i in range(6)]
    rows += [(20, "http://a.de/empty", page("")), (21, "http://other.de/empty", page("")), (22, None, page("", "fr")), (23, "http://b.com/z", page("", "en"))]
    got = {r["page_id"]: r for r in language.identify(pages(spark, rows), languages, model).collect()}

    text = {}
    for i, _, html in rows:
        body = " ".join(t for t, _ in language.page_text.analyse(html)[2])
        s = language.TEMPER * (language.trigrams(body) @ model) if body else np.zeros(3)
        text[i] = s - np.log(np.exp(s - s.max()).sum()) - s.max()
    p = {i: np.exp(t) for i, t in text.items()}
    host = {i: language.page_text.host_of(u) for i, u, _ in rows}
    suffix = {i: h.rpartition(".")[2] for i, h in host.items()}
    said = {i: (language._DECLARED.search(h) or ["", ""])[1] for i, _, h in rows}
    total, kinds = sum(p.values()), len(set(said.values()))
    for i in p:
        h = sum(p[j] for j in p if host[j] == host[i])
        s = sum(p[j] for j in p if suffix[j] == suffix[i])
        n, m = sum(host[j] == host[i] for j in p), sum(suffix[j] == suffix[i] for j in p)
        d = sum(p[j] for j in p if said[j] == said[i])
        world = (total - p[i] + 1) / (len(p) - 1 + 3)
        by_suffix = (s - p[i] + 5 * world) / (m - 1 + 5)
        prior = np.maximum((h - p[i] + 5 * by_suffix) / (n - 1 + 5), 1e-9)
        joint = text[i] + np.log((d + 1) / (total + kinds)) + np.log(prior)
        want = np.exp(joint - joint.max())
        assert got[i]["lang"] == languages[int(joint.argmax())]
        assert abs(got[i]["probability"] - want.max() / want.sum()) < 1e-9
    assert got[20]["lang"] == got[21]["lang"] == "de" and got[23]["lang"] == "en"


def test_odd_rows(spark):
    languages, model = language.fit(documents(spark))
    rows = [(1, None, None), (1, "http://[x", ""), (None, "nonsense", "<p>" + "the forest " * 30_000)]
    found = language.identify(pages(spark, rows), languages, model).collect()
    assert len(found) == 3 and all(r["lang"] in languages and 0 < r["probability"] <= 1 for r in found)
    assert [r["lang"] for r in found if r["page_id"] is None] == ["en"]
    assert language.identify(pages(spark, []), languages, model).count() == 0
    nothing, empty = language.fit(documents(spark).filter("false"))
    assert nothing == [] and language.identify(pages(spark, rows), nothing, empty).count() == 0
