"""Controllers with many methods: what is scanned grows with the text, and rows are sent on in pieces."""

from __future__ import annotations

from oreline.sources import parsers as P


class Watched(str):
    """A text that notes how many characters are searched or counted."""

    scanned = 0

    def count(self, part: str, start: int = 0, end: int | None = None) -> int:
        Watched.scanned += (len(self) if end is None else end) - start
        return super().count(part, start, end)

    def find(self, part: str, start: int = 0, *end: int) -> int:
        at = super().find(part, start, *end)
        Watched.scanned += (len(self) if at < 0 else at) - start
        return at


def controller(n: int) -> str:
    return "@RestController\npublic class C {\n" + "".join(f'@GetMapping("/{k}")\n  public int m{k}(Long id)\n' for k in range(n)) + "}"


def test_a_text_is_scanned_once():
    Watched.scanned, text = 0, Watched(controller(400))
    found = P.controller_endpoints(text)
    assert [(r["path"], r["method_name"], r["line"]) for r in found] == [(f"/{k}", f"m{k}", 3 + 2 * k) for k in range(400)]
    assert Watched.scanned < 4 * len(text)


def test_rows_go_on_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(P, "SENT", 3)
    texts = spark.createDataFrame([(1, controller(7)), (2, None), (3, ""), (4, controller(3)), (5, controller(2))], "k long, t string")
    found = P.read_controllers(texts, "t", ["k"]).select("k", "method_name").collect()
    assert sorted(map(tuple, found)) == [(k, f"m{i}") for k, n in ((1, 7), (4, 3), (5, 2)) for i in range(n)]
