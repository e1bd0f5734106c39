import re

from repovitals.llm import licenses as li


def test_every_known_sentence_holds_an_anchor():
    assert all(re.search(li.ANCHOR, t) for t in li.SENTENCES.values())
    assert all(n in li.SENTENCES for _, rule in li.RULES for n in rule)


def test_detect(spark):
    s = li.SENTENCES
    wrapped = (s["mit-grant"] + "\n\n" + s["mit-keep"] + " " + s["mit-as-is"]).replace("rights to", "rights\nto").replace("shall be", "shall\n be")
    bsd = s["bsd-head"] + "\n1. " + s["bsd-source"] + "\n2. " + s["bsd-binary"]
    rows = [
        (0, "Words.\nReleased under the MIT License."), (1, "from from\nLicensed under CC BY-NC 4.0."), (2, wrapped), (3, bsd), (4, bsd + "\n3. " + s["bsd-name"]),
        (5, s["mit-keep"] + "\n" + s["mit-grant"]), (6, None), (7, ""), (8, "a license of no kind"), (9, "x. LICENSED under the apache license,  version 2.0! And\nreleased under the MIT License"),
        (10, s["apache-header"] + "\nSome other line\n" + s["apache-copy"]), (11, "the " * 50000 + "\nThis work is licensed under the GNU General Public License, version 3."), (None, "Released under the MIT License."),
        (15, bsd + "\n3. " + s["bsd-name"].replace(li.HOLE, "Acme Widgets, Inc.")), (16, bsd + "\n3. " + s["bsd-advertise"] + "\n4. " + s["bsd-name"].replace(li.HOLE, "the University")),
        (17, bsd + "\nand a second file\n" + bsd + "\n3. " + s["bsd-name"]), (18, "\n".join([s["bsd-head"], s["bsd-source"], s["bsd-binary"], s["bsd-name"].replace("nor the", "nor\nthe")])),
        (19, "// SPDX-License-Identifier: GPL-2.0-or-later\ncode"), (20, s["lgpl21-free"] + " " + s["lgpl-hope"]), (21, s["gpl-hope"] + " " + s["gpl-free"]), (22, s["bsd-head"] + "\n" + s["bsd-name"]),
        (23, s["cc0-notice"].replace(li.HOLE, "Jane Doe")), (24, s["unlicense-domain"]),
        (12, "He said: Licensed under the Apache License, Version 2.0. And more."), (13, s["gpl-free"] + " " + s["gpl-hope"]), (14, s["mpl-header"]),
    ]
    docs = spark.createDataFrame([(*r, 1) for r in rows + rows[:1]], "doc_id long, text string, licenses int").repartition(3)
    out = li.detect(docs).collect()
    assert len(out) == len(rows) + 1
    got = {r["doc_id"]: r["licenses"] for r in out}
    want = {0: "MIT", 1: "CC-BY-NC-4.0", 2: "MIT", 3: "BSD-2-Clause", 4: "BSD-3-Clause", 5: "", 6: "", 7: "", 8: "", 9: "Apache-2.0,MIT", 10: "Apache-2.0", 11: "GPL-3.0", None: "MIT", 12: "Apache-2.0", 13: "GPL-3.0-or-later", 14: "MPL-2.0", 15: "BSD-3-Clause", 16: "BSD-4-Clause", 17: "BSD-2-Clause,BSD-3-Clause", 18: "BSD-3-Clause", 19: "GPL-2.0-or-later", 20: "LGPL-2.1-or-later", 21: "", 22: "", 23: "CC0-1.0", 24: "Unlicense"}
    assert {k: v for k, v in got.items() if v != want[k]} == {}
    assert li.detect(docs.limit(0)).count() == 0
