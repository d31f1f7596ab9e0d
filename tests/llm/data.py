"""Documents of the smallest table and odd ones, and tables with nothing in them."""

SF = "/root/testdata/sf0.001"
LONG = "Lorem ipsum dolor! " * 30_000
ODD = [
    (10**6, "a@b.com_c@d.org x@y z@@b.c 1.2.3.4.5.6.7.8 1.2.3.999.1.1.1 4485275742308327 é😀 +1 (017) 555-7713 ... MIT License mit license\n\nCC-BY cc by CC BY"),
    (10**6 + 1, None),
    (10**6 + 2, ""),
    (10**6 + 3, " \n\t "),
    (10**6 + 4, "one"),
    (10**6 + 4, "one"),
    (None, "Apache License one two three 0.0.0.0 256.1.1.1 01.002.3.4 +1 2 3"),
    (10**6 + 5, "<|endoftext|> <|ENDOFTEXT|> don't  'S Σας  日本\x1c語\u00a0x\u2003y e\u0301 É.,;"),
    (10**6 + 6, LONG),
    (10**6 + 7, "1.1.1.1 " * 700 + "9" * 5000 + " " + "x" * 20_000 + "@"),
    (10**6 + 8, "A b c d e f g h\nA b c d e f g h\n" * 8),
    (10**6 + 9, "A b c d e f g h\nA b c d e f g h\n" * 8),
    (10**6 + 10, "Permission is hereby GRANTED, free of charge, to any person obtaining a copy of this software and associated files\n to deal in the Software without restriction\n\nx"),
]


def documents(spark):
    """With columns whose names the operators use themselves."""
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = base.union(spark.createDataFrame(ODD, "doc_id bigint, text string"))
    return docs.selectExpr("doc_id", "text", "'xx' lang", "cast(null as string) source", "char_length(text) n_chars", "1 score", "2 spans", "3 row", "4 b", "5 n", "6 rep", "7 _")


def nothing(spark):
    return documents(spark).where("false")
