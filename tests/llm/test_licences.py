import re

from sluice.llm import licences as L


def brute(text, dice):
    out, best = [], {}
    for unit, parts in (("line", text.split("\n")), ("paragraph", re.split(r"\n[ \t\r]*\n", text)), ("text", [text])):
        for place, part in enumerate(parts):
            g = set(L.bigrams(part))
            scores = [(-2 * len(g & set(b)) / (len(g) + len(b)), name) for name, _, b, _ in L.notices(L.TEMPLATES) if g]
            if scores and -min(scores)[0] >= dice:
                out.append((unit, place, min(scores)[1], round(-min(scores)[0], 6)))
    words = L.plain(text).split()
    for name, _, b, m in L.notices(L.TEMPLATES):
        runs, last = [], None
        for place in range(0, len(words) - 1, L.step_of(m)):
            w = words[place : place + m]
            d = 2 * len({f"{x} {y}" for x, y in zip(w, w[1:], strict=False)} & set(b)) / (len(w) - 1 + len(b))
            if d >= dice:
                if last is None or place - last >= m:
                    runs.append([])
                runs[-1].append((-d, place))
                last = place
        for d, place in map(min, runs):
            best[place] = min(best.get(place, (0, "")), (d, name))
    return out + [("window", place, name, round(-d, 6)) for place, (d, name) in best.items()]


def test_anchors_lose_nothing():
    words = set(L.anchors(L.TEMPLATES, L.DICE))
    for _, _, grams, _ in L.notices(L.TEMPLATES):
        assert sum(not words & set(g.split(" ")) for g in grams) < L.least_common(len(grams), L.DICE)


def test_scan_equals_brute_force(spark):
    mit, apache = L.TEMPLATES["MIT"][2], L.TEMPLATES["Apache-2.0"][1]
    texts = [None, "", "no notice at all", "Released under the MIT Licence.", "a b c\nLicensed under CC BY-NC 4.0.\n\nRELEASED under the MIT License!\n" * 2, mit, mit.replace("Software", "Program", 1), "x " * 400 + mit, apache[:300] + "\n" + apache[300:], "license " * 5000, "Licensed under the Apache License, Version 1.1."]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "Released under the MIT License.", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.unit, r.place, r.licence, r.dice) for r in L.scan(df).collect())
    assert got == sorted((i is None, i or 0, *m) for i, t, _ in rows if t for m in brute(t, L.DICE))
    assert L.scan(df.limit(0)).count() == 0


def licences_of(spark, text):
    return {r.licence for r in L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}


def test_licence_files_and_notices_within_text(spark):
    wrap = lambda text, start="": "\n".join(start + " ".join(w) for w in (text.split()[i : i + 11] for i in range(0, len(text.split()), 11)))
    mit = "MIT License\n\nCopyright (c) 2021 Some One\n\n" + wrap(L.TEMPLATES["MIT"][2]) + "\n\n" + wrap(L.TEMPLATES["MIT"][3].removeprefix(L.TEMPLATES["MIT"][2]).strip()) + "\n"
    body = L.TEMPLATES["BSD-3-Clause"][2]
    bsd = "Copyright (c) 2020, Some One\nAll rights reserved.\n\n" + wrap(body.replace("Redistributions of", "1. Redistributions of", 1).replace("Redistributions in", "\n2. Redistributions in", 1).replace("Neither", "\n3. Neither", 1))
    source = "#!/usr/bin/env python\n# Copyright 2020 Some One\n#\n" + wrap(L.TEMPLATES["Apache-2.0"][1], "# ") + "\nimport os\n" + "x = os.path\n" * 50
    inline = "This is a long line about something else. Released under the MIT License. More prose follows here, and more. " * 2
    assert licences_of(spark, mit) == {"MIT"} and licences_of(spark, bsd) == {"BSD-3-Clause"}
    assert "Apache-2.0" in licences_of(spark, source) and licences_of(spark, inline) == {"MIT"}
