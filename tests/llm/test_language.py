import pytest

from spindrift.llm import language as L

TEXTS = {
    "en": "The committee met on Monday and decided that the budget for the coming year should be raised, although several members were not convinced. Every department has to report how many people it needs and what the work will cost before the end of the month. Nobody knows whether the new building will be ready by then.",
    "de": "Der Ausschuss traf sich am Montag und beschloss, dass der Haushalt für das kommende Jahr erhöht werden soll, obwohl einige Mitglieder nicht überzeugt waren. Jede Abteilung muss vor Ende des Monats berichten, wie viele Leute sie braucht und was die Arbeit kosten wird. Niemand weiß, ob das neue Gebäude bis dahin fertig ist.",
    "fr": "Le comité s'est réuni lundi et a décidé que le budget de l'année prochaine devait être augmenté, bien que plusieurs membres n'aient pas été convaincus. Chaque service doit indiquer avant la fin du mois de combien de personnes il a besoin et ce que le travail coûtera. Personne ne sait si le nouveau bâtiment sera prêt.",
}


def brute_phrases(data, sample):
    n, i = 0, 0
    while i < len(data):
        k = 0
        while i + k < len(data) and data[i : i + k + 1] in sample:
            k += 1
        n, i = n + 1, i + max(k, 1)
    return n


def test_automaton_against_substring_search():
    sample = L.symbols(TEXTS["en"])
    step = L.suffix_automaton(sample)
    for t in TEXTS.values():
        data = L.symbols(t)
        assert L.phrases(step, data) == brute_phrases(data, sample)
    assert L.phrases(step, b"") == 0 and L.phrases(step, sample[10:90]) == 1


@pytest.mark.parametrize(("label", "want"), [("en", "en"), (" EN-us ", "en"), ("German", "de"), ("pt_BR", "pt"), ("fra", "fr"), ("", None), (None, None), ("latin", None), ("??", None), ("und", None), ("ja", None), ("entirely", None)])
def test_labels(label, want):
    assert L.label_of(label) == want


def held(text, m):
    """The languages that count in a text, each once, in order."""
    return list(dict.fromkeys(x[0] for x in L.judge(text, m) if x[5]))


def model():
    return {g: L.suffix_automaton(L.symbols(t)) for g, t in TEXTS.items()}


def test_passages_and_short_texts():
    m = model()
    mixed = TEXTS["en"][:160] + "\n\n" + TEXTS["de"][:160] + "\n\n| a | 1 |\n{\"k\": \"der die das\"}\n"
    assert set(held(mixed, m)) == {"en", "de"}
    assert held(TEXTS["fr"].upper(), m) == ["fr"]
    assert held(TEXTS["en"] + " „Umsatz je Jahr“", m) == ["en"]
    assert L.judge(None, m) == [] and L.judge("", m) == [] and L.judge("Der Ausschuss.", m) == []
    assert L.judge("| 1 | 2 |\n" * 50, m) == [] and L.judge("[2026-03-13 17:18] " + TEXTS["de"], m)[0][0] == "de"


def test_wrong_labels_are_cleaned_from_the_sample():
    pieces = {g: [t[i : i + 150] for i in range(0, 150, 10)] for g, t in TEXTS.items()}
    sample = [(g, p) for g, ps in pieces.items() for p in ps] + [("fr", pieces["en"][3]), ("de", pieces["en"][5])]
    m = L.train(sample)
    assert all(L.judge(t, m)[0][0] == g for g, t in TEXTS.items())


def test_operator(spark, as_rows):
    rows = [(1, TEXTS["en"], "English", "x"), (2, TEXTS["de"], None, "x"), (3, TEXTS["fr"], "de", "x"), (4, None, None, None), (5, "", "en", "x"), (6, TEXTS["en"] + "\n\n" + TEXTS["fr"], "en", "x"), (1, TEXTS["en"], "en_GB", "x"), (7, TEXTS["en"] * 100, "fr", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, label string")
    found = L.languages(docs, model())
    assert as_rows(L.mislabelled(found), "doc_id", "lang") == [(2, "de"), (3, "fr"), (6, "en"), (6, "fr"), (7, "en")]
    assert found.filter("confidence < 0 or confidence > 1").count() == 0
    assert as_rows(found.filter("doc_id = 6"), "passage", "lang", "counts", "languages") == [(0, "en", True, 2), (1, "fr", True, 2)]
    assert L.languages(docs.limit(0), model()).count() == 0
    L.languages(docs).count()  # trained on itself, with languages lacking


def test_prose_in_tags():
    m, de = model(), TEXTS["de"]
    paragraphs = "".join(f"<p>{x}.</p>\n" for x in de.rstrip(".").split(". "))
    found = L.judge(paragraphs, m)
    assert [x[0] for x in found] == ["de"] and paragraphs[found[0][1] : found[0][2]].strip() == paragraphs.strip()
    assert held(f'<div class="a b"><p>{de}</p><table><tr><td>{TEXTS["fr"]}</td></tr></table></div>', m) == ["de"]
    assert set(held(f"<p>{TEXTS['en']}</p>\n<p>{TEXTS['fr']}</p>", m)) == {"en", "fr"}
    assert L.judge("<p>| der | die |</p>\n<p>{\"k\": \"der die das und\"}</p>\n<?php echo der_die_das_und_noch_mehr_davon();\n" * 3, m) == []


def test_operator_with_prose_in_tags_and_no_label(spark, as_rows):
    docs = spark.createDataFrame([(1, f"<p>{TEXTS['de']}</p>", None), (2, f"<p>{TEXTS['fr']}</p>", "??"), (3, f"<p>{TEXTS['en']}</p>", "en")], "doc_id long, text string, lang string")
    assert as_rows(L.mislabelled(L.languages(docs, model())), "doc_id", "lang") == [(1, "de"), (2, "fr")]


def test_prose_behind_marks_of_fences():
    m, en, de, code = model(), TEXTS["en"], TEXTS["de"], "Wir = der_die_das\nund noch eine Zeile aus dem Quelltext, die niemand liest\n"
    assert held(f"```\n{de}\n", m) == ["de"]  # never closed
    assert held(f"``` {de}\n", m) == ["de"]
    assert set(held(f"{en} ```\n{code}``` {de}\n", m)) == {"en", "de"}  # both marks glued to prose
    assert set(held(f"{en}\n```python\n{code}``` {de}\n\n```\n{code}```\n", m)) == {"en", "de"}
    assert held(f"{en}\n```python\n{TEXTS['fr']}\n```\n", m) == ["en"]  # fenced
    text = f"{en} ```\n{code}``` {de}\n"
    assert [text[s:e].strip() for s, e, prose in L.units(text) if prose and s > len(en)] == [x + "." for x in de.rstrip(".").split(". ")]


def test_every_passage_is_reported():
    m, parts = model(), [TEXTS["en"], TEXTS["fr"], TEXTS["en"], TEXTS["fr"]]
    text = "\n\n".join(parts)
    found = L.judge(text, m)
    assert [(g, text[s:e].strip()) for g, s, e, *_ in found] == list(zip(["en", "fr", "en", "fr"], parts)) and all(x[5] for x in found)
    short = TEXTS["en"] + "\n\nMots courts.\n\n" + TEXTS["en"]
    assert held(short, m) == ["en"]


def test_other_languages_are_none_of_the_known():
    polish = "Wczoraj wieczorem szliśmy wzdłuż rzeki i rozmawialiśmy o dawnych czasach, kiedy każde dziecko we wsi umiało pływać i nikt nie bał się ciemnej wody pod mostem."
    spanish = "Anoche caminamos junto al río y hablamos de los viejos tiempos, cuando todos los niños del pueblo sabían nadar y nadie tenía miedo del agua oscura bajo el puente."
    for other in (polish, spanish):  # the model knows English, German and French
        assert [(x[0], x[5]) for x in L.judge(other, model())] == [(None, False)]
    assert held(polish + "\n\n" + TEXTS["de"], model()) == ["de"]


def test_prose_around_objects_and_rows_in_its_line():
    m, data, row = model(), '{"entity_id": "X", "n": {"der": "die das und"}}', "| 94,634 | 36,702 | 53.7 |"
    assert held(f"{TEXTS['de']} {data} {row} {TEXTS['fr']}", m) == ["de", "fr"]
    assert held(f"{data} {TEXTS['en']} {row}", m) == ["en"]
    quoted = "\n".join("| " + w for w in TEXTS["fr"].replace(" que ", "\nque ").split("\n"))
    assert held(quoted, m) == ["fr"] and held("| der | die |\n" * 30, m) == []


def test_sample_in_two_scans(spark):
    rows = [(i, f"{g} {i} " + t * 2, lab) for g, lab in (("en", "English"), ("de", "de-AT"), ("fr", "fra")) for i, t in enumerate([TEXTS[g]] * 9)]
    docs = spark.createDataFrame(rows * 2 + [(99, "x" * 300, "ja"), (98, "short", "en"), (97, None, "en")], "doc_id long, text string, lang string")
    sample = L.training_sample(docs, rows=4)
    assert {g for g, _ in sample} == {"en", "de", "fr"} and all(2 <= sum(h == g for h, _ in sample) <= 4 for g in TEXTS)
    assert len(set(sample)) == len(sample) and all(t in {r[1] for r in rows} for _, t in sample)
    assert L.training_sample(docs.limit(0)) == []
