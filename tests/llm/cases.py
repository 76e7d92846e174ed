"""Inputs that several tests share."""

SMALL = "/root/testdata/sf0.001"

LONG = "\n".join(f"Line {i} of a very long text with word{i % 97} and token = \"abcdefgh{i % 11}\"" for i in range(20_000))

#: Nulls, empty and very long texts, ties and repeated rows.
HARD = [
    (1, None, None, None), (2, "", "en", "a"), (3, "  \t\n \n", "en", "a"), (4, LONG, "en", "a"),
    (5, "same text here\nsame line\nsame line", "en", "b"), (6, "same text here\nsame line\nsame line", "de", "b"),
    (6, "same text here\nsame line\nsame line", "de", "b"), (None, "no id at all", "fr", None),
    (None, "no id at all", "fr", None), (7, "a" * 200_000, "fr", "a"), (8, "1" * 100_000, None, "c"),
    (9, " ".join(["word"] * 5000), "es", "c"), (10, "\x00 \U0001f600 + & éé", "es", "c"),
]
