import random

from pyspark.sql import functions as F

from codestrata.llm import languages as L, mixing as M, scans as S

SENT = {
    "en": ["The report lists functions that nobody calls.", "If the index is missing, the scanner writes a warning.", "We moved the cache into its own package."],
    "de": ["Der Bericht nennt Funktionen, die niemand aufruft.", "Wenn der Index fehlt, schreibt das Programm eine Warnung.", "Wir haben den Zwischenspeicher in ein eigenes Paket verschoben."],
    "es": ["El informe muestra funciones que nadie llama.", "Si falta el índice, el programa escribe una advertencia.", "Movimos la memoria a su propio paquete."],
    "ja": ["索引がない場合、プログラムは警告を書き出します。", "レポートを独立したパッケージに移しました。", "この変更は公開インターフェースには影響しません。"],
}
CODES = [("en", "eng", "English"), ("de", "deu", "German"), ("es", "spa", "Spanish"), ("ja", "jpn", "Japanese")]
CODE = "```py\ndef f(x):\n\n    return x\n```"


def corpus(seed=1, n=160):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SENT))
        rows.append((i, "\n\n".join(" ".join(rng.sample(SENT[lang], 2)) for _ in range(2)), lang if rng.random() > 0.1 else rng.choice(list(SENT))))
    return rows


def test_paragraphs_and_prose():
    t = "\n\n  \nA first sentence.\r\n\r\n" + CODE + "\n \n| a | b |\n| - | - |\n\n$ run --x 1\n\n`f(x: int) -> list`\n\n# A heading here\n\n## 4.2.7 (2024-09-20)\n\n@@ -1,2 +3,4 @@\n- a()\n+ b()\n\n3.12.7 8454524\n\n- one item of a list\n- and another one"
    ps = L.paragraphs(t)
    assert ps[0] == "A first sentence." and L.paragraphs("") == [] == L.paragraphs(" \n\n ")
    assert [p for _, p in L.prose(t)] == ["A first sentence.", "# A heading here", "- one item of a list\n- and another one"]


def test_labels_segments_and_held_out_accuracy(spark):
    rows = corpus() + [
        (900, "\n\n".join([SENT["en"][0], SENT["en"][1], SENT["de"][0], CODE]), "english"), (901, None, "en"), (902, "", "en"), (903, " \n ", None), (904, CODE, "en"), (905, SENT["de"][1], None), (906, SENT["es"][2], "en-US"), (907, SENT["ja"][0], "ja_JP"), (908, SENT["de"][2], " ger "), (909, " ".join(SENT["en"] * 3000), "EN"), (909, " ".join(SENT["en"] * 3000), "EN"), (910, SENT["en"][2], "??"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("code", F.lit(1)).withColumn("label", F.lit("x"))
    codes = spark.createDataFrame(CODES, "code string, code3 string, lang_name string")
    got = {(r.doc_id, r.para): r.lang for r in L.language_findings(L.document_languages(d, codes)).collect() if r.doc_id >= 900}
    assert got == {(900, 2): "de", (905, -1): "de", (906, -1): "es", (910, -1): "en"}
    model = L.Compression(L.train(d, L.known_codes(codes)))
    held = [(k, s.replace("funktionen", "x")) for k, v in SENT.items() for s in v]
    assert sum(model.classify(s)[0] == k for k, s in held) / len(held) >= 0.95
    assert L.language_findings(L.document_languages(d.limit(0), codes)).count() == 0


def test_mixing_reaches_targets_within_caps(spark):
    rng = random.Random(3)
    words = {"a": "alpha apple arrow", "b": "beta bread bridge", "c": "copper candle circle"}
    rows = [(i, " ".join(rng.choices(words[s].split(), k=rng.randrange(5, 40))), s, "en", "p", f"{s}/x.md") for i, s in enumerate(rng.choices("abc", [6, 3, 1], k=1500))]
    rows += [(5000, "alpha apple", None, None, None, None), (5001, None, "a", None, None, None), (5002, "x", "unlisted", None, None, None), (5003, "", "b", None, None, None), (1, rows[1][1], rows[1][2], "en", "p", rows[1][5])]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, project string, path string").withColumn("rate", F.lit(1)).withColumn("main", F.lit(2))
    t = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    r = {x.source: x for x in M.reached_shares(d, t).collect()}
    for s, want in (("a", 0.4), ("b", 0.3), ("c", 0.2)):
        assert abs(r[s].reached_share - want / 0.9) < 0.01 and r[s].most_repeats <= r[s].max_repeats
    assert r["none"].reached_share == 0
    mix = M.mixed_documents(d, t).collect()
    assert len({x.doc_id for x in mix}) == len(mix) and all(x.doc_id not in (5001, 5002, 5003) for x in mix)
    p = {x.doc_id: x.p for x in M.memberships(d, t)[0].where("doc_id in (5000, 5002)").collect()}
    assert max(range(4), key=lambda k: p[5000][k]) == 0 and sum(p[5002]) == 0
    assert M.mixed_documents(d.limit(0), t).count() == 0 and M.mixed_documents(d, t.limit(0)).count() == 0


TEXT = ["The report lists several functions that nobody calls from outside.", "Every run writes its own snapshot to the storage folder.", "Whoever changes the schema has to update the export formats.", "Large repositories should be split before they are scanned.", "The health score dropped because the folder has grown."]


def pages(n=60, seed=2):
    rng = random.Random(seed)
    return [" ".join(rng.sample(TEXT, 4)) for _ in range(n)]


def fitted():
    texts = pages()
    lexicon = {}
    for t in texts:
        for w in S._WORD.findall(t.lower()):
            lexicon[w] = lexicon.get(w, 0) + 1
    return S.Editor(lexicon, *S.train(texts, lexicon))


def test_repair():
    ed = fitted()
    page = "Guide To Pages | Part 2\n\nThe rep0rt lists several func-\ntions tbat nobody calls.\nEvery run writes its own snap\u00ad\nshot.\n\nWhoever changcs the schema\nhas to update.\n- 7 -"
    noise, text = ed.repair(page, {S.line_key("Guide To Pages | Part 1")})
    assert noise == ["header", "hyphenation", "misread", "page_number"]
    assert text == "The report lists several functions that nobody calls. Every run writes its own snapshot.\n\nWhoever changes the schema has to update."
    assert ed.repair(TEXT[0], set()) == ([], TEXT[0]) and ed.repair("", set()) == ([], "")
    assert ed.repair("The report lists\n31\nfunctions that nobody calls.", set())[0] == []


def test_held_out_words():
    ed, rng = fitted(), random.Random(8)
    words = [w for w in ed.lexicon if len(w) > 3]
    bad = [(w, b) for w in words * 5 if (b := S.damage(w, rng)) and b not in ed.lexicon]
    assert sum(ed.word(b) == w for w, b in bad) / len(bad) > 0.9
    assert all(ed.word(w) == w for w in words) and ed.word("jaxafuqu") == "jaxafuqu" and ed.word("1234") == "1234"


def test_operator(spark):
    rows = [(f"d{k}#{i}", f"d{k}", i, f"Handbook Of Tests | Part {i}\n{t}\nPage {i} of 9" if k < 3 else t, "x") for k in range(20) for i, t in enumerate(pages(3, k))]
    rows += [("n#0", None, 0, None, "x"), ("e#0", "e", 0, "", "x"), rows[0]]
    c = spark.createDataFrame(rows, "id string, doc_id string, idx int, text string, noise string").withColumn("key", F.lit(1)).withColumn("keys", F.lit("y"))
    docs = spark.createDataFrame([(f"d{k}", "pdf" if k < 3 else "text") for k in range(20)], "id string, kind string")
    got = {r.id: (r.noise, r.text) for r in S.repaired_chunks(c, docs).collect()}
    assert len(got) == 62 and all(got[f"d{k}#{i}"][0] == (["header", "page_number"] if k < 3 else []) for k in range(20) for i in range(3))
    assert got["n#0"] == ([], None) and got["e#0"] == ([], "")
    assert S.repaired_chunks(c.limit(0), docs).count() == 0


def test_line_keys_allow_small_variations():
    assert S.line_key("Loriboje Review Rccord    Rev. 3") == S.line_key("LORIBOJE REVIEW RECORD Rev. 12")


LEARN = {
    "en": "The scanner reads each folder once. A report names the owners of every module. Old snapshots are removed after thirty days. The team reviews large changes on Mondays. Cached results expire when the schema moves.",
    "de": "Der Scanner liest jeden Ordner einmal. Ein Bericht nennt die Besitzer jedes Moduls. Alte Stände werden nach dreißig Tagen entfernt. Das Team prüft große Änderungen am Montag. Gemerkte Ergebnisse verfallen, wenn sich das Schema bewegt.",
    "ru": "Сканер читает каждую папку один раз. Отчёт называет владельцев каждого модуля. Старые снимки удаляются через тридцать дней. Команда проверяет большие изменения по понедельникам. Сохранённые результаты устаревают, когда меняется схема.",
}
FRESH = {
    "en": "Every module names its owners, and the report reads the folder after thirty days.",
    "de": "Jedes Modul nennt seine Besitzer, und der Bericht liest den Ordner nach dreißig Tagen.",
    "ru": "Каждый модуль называет владельцев, и отчёт читает папку через тридцать дней.",
}
FOREIGN = ["Якщо індекс відсутній, програма записує попередження у журнал і продовжує роботу без нього.", "Om indexet saknas skriver programmet en varning i loggen och fortsätter sedan utan det."]


def test_fresh_sentences_and_languages_without_a_dictionary():
    texts = {k: (v + "\n").encode() for k, v in LEARN.items()}
    held = [(k, s + ".") for k, v in LEARN.items() for s in v.split(". ")[:2]] + [(k, v) for k, v in FRESH.items()]
    m = L.Compression(texts, *L.calibrate(texts, held))
    assert {k: m.classify(v)[0] for k, v in FRESH.items()} == {k: k for k in FRESH}
    assert [m.classify(x)[0] for x in FOREIGN] == [None, None]
    assert all(0 <= m.classify(x)[1] < 0.5 for x in FOREIGN) and all(m.classify(x)[1] > 0.5 for x in FRESH.values())


def test_confusions_are_learned_and_fixes_joined(spark):
    base = "harbour lantern journey capture monster picture furniture thunder winter orchard blanket merchant captain garden silver".split()
    texts = [" ".join(base) for _ in range(60)] + [" ".join(w.replace("r", "z") for w in base)] + ["The harbouz and the thundez lanteZn."]
    c = spark.createDataFrame([(f"d#{k}", "d", k, t) for k, t in enumerate(texts)], "id string, doc_id string, idx int, text string")
    counts = S.word_counts(c)
    assert ("z", "r") in S.learned_confusions(counts)
    known, parts = S.fit(c, spark.createDataFrame([], "id string, kind string"))
    words = spark.createDataFrame([("harbouz",), ("thundez",), ("Harbouz",), ("harbour",), ("zzz",)], "word string")
    got = {r.word: r.fixed for r in S.word_fixes(words, known, spark.sparkContext.broadcast(parts)).collect()}
    ed = S.Editor({r.word: r.n for r in known.collect()}, *parts)
    assert got == {w: ed.word(w) for w in ("harbouz", "thundez", "Harbouz", "harbour", "zzz") if ed.word(w) != w}
    assert got["harbouz"] == "harbour" and got["Harbouz"] == "Harbour" and "harbour" not in got


def test_documents_keep_the_caps_of_their_source(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choices(["alpha", "beta", "gamma"][k % 2 : k % 2 + 2], k=20)), None if k % 7 == 0 else "ab"[k % 2], "en", None, None) for k in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, project string, path string")
    t = spark.createDataFrame([("a", 0.2, 1), ("b", 0.8, 5)], "source string, target_share double, max_repeats int")
    mix, goals, _ = M.mixture(d, t)
    caps = [g[2] for g in goals]
    got = mix.collect()
    assert all(r.repeats <= caps[max(range(2), key=lambda k: r.p[k])] for r in got if sum(r.p)) and max(r.repeats for r in got) > 1
