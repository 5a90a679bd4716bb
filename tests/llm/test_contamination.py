import random

from spindrift.llm import contamination as L

WORDS = [f"w{i}" for i in range(60)]


def brute(docs, cases, n):
    out = set()
    for d, t in docs:
        ws = L.words_of(t)
        have = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
        for c, *fields in cases:
            for f in fields:
                fs = L.words_of(f)
                if any(tuple(fs[i : i + n]) in have for i in range(len(fs) - n + 1)):
                    out.add((d, c))
    return sorted(out, key=repr)


def test_against_brute_force(spark, as_rows):
    rnd = random.Random(4)
    say = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    cases = [(f"c{i}", say(40), say(rnd.choice([3, 12, 20]))) for i in range(12)] + [("none", None, None), ("short", "w1 w2", ""), ("c0", "other words", None)]
    docs = []
    for i in range(80):
        t = say(rnd.randrange(5, 60))
        if rnd.random() < 0.5:
            src = rnd.choice(cases[:12])[1].split()
            a = rnd.randrange(20)
            t = t + " " + " -- ".join(x.upper() for x in src[a : a + rnd.choice([11, 12, 13, 20])]) + "; " + say(5)
        docs.append((i, t))
    docs += [(90, None), (91, ""), (92, "w1 " * 50_000), (0, docs[0][1])]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, case_id string")
    cs = spark.createDataFrame(cases, "case_id string, passage string, query string")
    want = brute(docs, cases, 12)
    assert want and as_rows(L.leaks(df, cs).select("doc_id", "case_id").distinct()) == want
    full = as_rows(L.leaks(df, cs))
    assert as_rows(L.leaks(df, cs, block_items=60)) == full  # many blocks
    assert as_rows(L.leaks(df, cs, broadcast_rows=0)) == full  # salted join with the cases
    assert L.leaks(df.limit(0), cs).count() == 0 and L.leaks(df, cs.limit(0)).count() == 0


def test_counts_and_shares(spark):
    case = " ".join(WORDS[:30])
    df = spark.createDataFrame([(1, "x " + " ".join(WORDS[5:20]) + " y"), (2, " ".join(WORDS[:11]))], "doc_id long, text string")
    r = L.leaks(df, spark.createDataFrame([("c", case, "")], "case_id string, passage string, query string")).collect()
    assert [(x.doc_id, x.field, x.items, x.covered, x.share) for x in r] == [(1, "passage", 4, 15, 0.5)]


def test_words_whose_folding_is_not_lower_case(spark, as_rows):
    passage = "Die Straße zum Hafen wird im Herbst wieder gesperrt und dann erneuert"
    ligature = "The ofﬁce closed its counters in the year before the new terminal opened"
    greek = "ο λόγος του πρώτου έτους ήταν μεγάλος και ο δεύτερος στόχος της εταιρείας"
    turkish = "İstanbul limanı bu yıl da çok büyük bir artış gösterdi ve yeni hat açıldı"
    docs = [(1, f"Bericht: {passage}."), (2, passage.upper()), (3, passage.replace("Hafen", "Bahnhof")), (4, ligature), (5, None), (6, f"x {greek.upper()} y"), (7, f"{turkish}; und mehr")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    cs = spark.createDataFrame([("street", passage, None), ("office", None, ligature), ("greek", greek, None), ("turkish", turkish, None)], "case_id string, passage string, query string")
    assert as_rows(L.leaks(df, cs).select("doc_id", "case_id")) == [(1, "street"), (2, "street"), (4, "office"), (6, "greek"), (7, "turkish")]
    assert {r.word: r.df for r in L.document_frequencies(df, ["strasse", "office", "nowhere"]).collect()} == {"strasse": 3, "office": 1}
