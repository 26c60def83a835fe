"""Rows that every operator must take."""

EDGES = [
    (0, "The quick brown fox jumps over the lazy dog and then it rests for a while under the old oak tree."),
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "The quick brown fox jumps over the lazy dog and then it rests for a while under the old oak tree."),
    (5, "Zażółć gęślą jaźń 漢字 😀 " * 3),
    (6, "a  b   c \n\n d\x00e <|endoftext|> " + "x" * 300),
    (7, "word " * 4000),
    (None, "a document that has no id but some words in it to be counted and compared with the others"),
    (8, "tie"),
    (8, "tie"),
    (9, "tie"),
]
