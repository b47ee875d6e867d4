"""Substring dedup of short lines and sentences, and of paragraphs set anew."""

from tabulens.llm import unit_dedup

VERSE = "Roses are red\nviolets are blue\nsugar is sweet\nand so are you"
ROWS = [
    (1, "All rights reserved\nSome text of one document only.\n漢字だけの行\n---"),
    (2, "Other words that one document has.\n\nall rights reserved.\n漢字だけの行\n---"),
    (3, f"Before.\n\n{VERSE}\n \nNo twin."),
    (4, f"Also before.\n\n{VERSE.replace(chr(10), ' ')}\n\nNor this."),
    (5, f"{VERSE}\n\nQuite new. Yes it is! Fine."),
    (6, "Unlike. Yes it is! Otherwise.\n*** . Alone here"),
]


def test_short_units(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    text = dict(ROWS)
    got = sorted((r["doc_id"], text[r["doc_id"]][r["start"] : r["end"]], r["keep_id"], r["copies"]) for r in unit_dedup.repeats(docs, sentence=1).collect())
    assert got == [
        (2, "---", 1, 2),
        (2, "all rights reserved.", 1, 2),
        (2, "漢字だけの行", 1, 2),
        (4, VERSE.replace("\n", " "), 3, 3),
        (5, VERSE, 3, 3),
        (6, "Yes it is! ", 5, 2),
    ]
    left = {r["doc_id"]: r["text"] for r in unit_dedup.remove(docs, sentence=1).collect()}
    assert left[1] == text[1] and left[3] == text[3] and left[6] == "Unlike. Otherwise.\n*** . Alone here"


def test_short_sentences_stay_unless_asked_for(spark):
    """Lines of any length go; a sentence goes from so many words on."""
    long = "Every word of this sentence stands in two documents."
    rows = [(1, f"One. {long} Yes it is!\nShort line"), (2, f"Two. {long} Yes it is!\nshort line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    for least, want in ((unit_dedup.SENTENCE, [long + " ", "short line"]), (10, ["short line"]), (1, [long + " ", "Yes it is!", "short line"])):
        got = sorted((r["start"], text[r["doc_id"]][r["start"] : r["end"]]) for r in unit_dedup.repeats(docs, least).collect())
        assert [x for _, x in got] == want
