"""The sample tables and rows that the tests share."""

SAMPLE = "/root/testdata/sf0.001"

ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (None, "one two three four five six"),
       (None, None), (6, "word " * 3000), (7, "é漢字 🙂 \x00\x1c end"), (8, "a" * 5000)]
