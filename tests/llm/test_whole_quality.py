"""Quality rules in a group whose words are lines without blanks."""

from corpusmill.llm.quality import quality


def test_long_words(docs_of):
    """Means of 120 to 139 characters are typical of the group; one of 3,000 is not."""
    def text(i, length):
        return "\n".join(chr(0x4E00 + 60 * (i % 100) + k) * length for k in range(60))

    rows = [(i, text(i, 120 + i % 20), "ja", "web") for i in range(200)] + [(999, text(999, 3000), "ja", "web")]
    assert [r.doc_id for r in quality(docs_of(rows)).filter("NOT kept").collect()] == [999]
