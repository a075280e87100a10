"""Rows with nulls, empty, tied, repeated and very long texts."""

ODD = [
    (1, "", "en", "a", 0), (2, None, "en", "a", 0), (3, " \t\n ", None, None, 3), (4, "Alpha beta Gamma delta", "en", "a", 22),
    (5, "alpha BETA gamma delta", "en", "b", 22), (6, "one", "en", "b", 3), (7, "one two", "en", "b", 7), (7, "one two", "en", "b", 7),
    (None, "one two three", "en", "b", 13), (9, "É è  ẞ ß \x0b\x0c x y   z  \n\n q", "fr", "c", 20), (10, "word " * 30_000, "en", "c", 150_000),
    (11, "x" * 50_000, "en", "c", 50_000), (12, "the MIT License, the mit  license and GNU General\nPublic License; Apache-License", "en", "c", 70),
    (13, "\n".join(f"line {i} of many words here" for i in range(12)), "en", "c", 300),
    (14, "intro\n" + "\n\n".join(f"line {i} of many words here" for i in range(3, 12)) + "\nend", "en", "d", 300),
    (15, "don't they're 12345 ... !!! <|endoftext|> <|startoftext|> é ẞ İ 한국어 日本 🙂", "xx", "d", 60),
]
ODD_TEXTS = [row[1] or "" for row in ODD]
