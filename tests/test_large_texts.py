"""What long texts and many pages cost."""

import tracemalloc

import pyarrow as pa

from tidemark.functions import text, wordpiece


def test_a_long_text_is_read_as_far_as_its_ids_go(monkeypatch):
    asked = []

    class Counted:
        normalize = staticmethod(wordpiece.unicodedata.normalize)

        @staticmethod
        def category(c, found=wordpiece.unicodedata.category):
            asked.append(c)
            return found(c)

    monkeypatch.setattr(wordpiece, "unicodedata", Counted)
    pieces = wordpiece.WordPieces({"[UNK]": 0, "[CLS]": 1, "[SEP]": 2, "a": 3, "##a": 4})
    assert pieces.encode("\u00e4a " * 100_000) == [1, *[3, 4] * 255, 2]
    assert len(asked) < 10_000


def test_pages_are_not_python_texts_all_at_once():
    pages = pa.array(["<p>" + "x" * 20_000 + "</p><script>y</script>", None] * 1000)
    tracemalloc.start()
    out = text.html_texts(pages)
    assert tracemalloc.get_traced_memory()[1] < 8_000_000
    tracemalloc.stop()
    assert out[0].as_py() == "x" * 20_000 and len(out) == 2000 and out[1].as_py() == ""
    assert len(text.html_texts(pa.array([], pa.string()))) == 0
