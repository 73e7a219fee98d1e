from gleanworks.llm import license_scan as ls


def test_spellings_marks_and_copyright_lines(spark):
    mit = ls.LICENSES["MIT"]
    shouted = "Copyright (c) 2019 Some Body\n\n" + mit.upper().replace("COPYRIGHT HOLDERS", "COPYRIGHT OWNERS").replace("SUBLICENSE", "SUB-LICENCE").replace("NONINFRINGEMENT", "NON-INFRINGEMENT").replace(".", " .\r\n")
    rows = [(1, mit), (2, shouted), (3, mit + " and more"), (4, "Some prose.\n  Released under the MIT Licence!\nLICENSED UNDER CC BY-NC 4.0\n"), (5, "It is released under the MIT License."),
            (6, None), (7, ""), (None, ls.LICENSES["Zlib"]), (1, mit), (8, "..\n-- \n"), (9, "x " * 200_000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, license string, digest int")
    got = sorted(((r.doc_id, r.license, r.notices, r.licensed) for r in ls.scan(docs).collect()), key=str)
    want = [(1, "MIT", "", True), (2, "MIT", "", True), (3, None, "", False), (4, None, "CC-BY-NC-4.0,MIT", True), (5, None, "", False), (6, None, "", False), (7, None, "", False),
            (None, "Zlib", "", True), (1, "MIT", "", True), (8, None, "", False), (9, None, "", False)]
    assert got == sorted(want, key=str)
    assert ls.scan(docs.limit(0)).collect() == []


def test_known_digests_differ(spark):
    texts, notices = ls._known(spark)
    assert texts.select("digest").distinct().count() == len(ls.LICENSES)
    assert set(notices.values()) == set(ls.NOTICES)
