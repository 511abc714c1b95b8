"""Exact, memoised tokenising of whole texts by cutting them where every pre-token must end.

No pre-token of the byte-level pattern holds a space after a non-space character.  A text may
therefore be cut before any space or newline that follows a non-space character, and the tokens of
the whole text are the tokens of the parts in order.  Parts repeat far more often than texts, so each
worker keeps a bounded memo from part to value.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

MEMO_PARTS = 800_000  # entries kept per worker (about 200 MB), in two halves: a full half becomes the old one
TAIL = ".,;:!?&%$#*|"  # marks that may follow a word


class Pieces:
    """Memo of ``encode(part) -> value`` with ``values(text)`` giving the values of a text in order."""

    def __init__(self, encode: Callable[[str], object], limit: int = MEMO_PARTS):
        self.encode, self.limit = encode, limit // 2
        self.memo, self.tails = {}, {}  # values of parts after a space or with their newline, and of marks after a word
        self.old: dict = {}             # the parts of the half before: one found there is kept again, not encoded again

    def values(self, text: str) -> list:
        if not text:
            return []
        # every newline starts a part of its own; any other part but the first follows one space
        parts = text.replace("\n", " \n").split(" ")
        get, memo, tails, out = self.memo.get, self.memo, self.tails, []
        held = parts[0]  # text that ends in white space and waits for what follows
        if held and not held[-1].isspace():
            out.append(self.encode(held))
            held = ""
        for p in parts[1:]:
            if not held:
                v = get(p)
                if v is not None:
                    out.append(v)
                    continue
            s = p if p[:1] == "\n" else " " + p
            if not p or p[-1].isspace():
                held += s
            elif held:
                out.append(self.encode(held + s))
                held = ""
            else:
                head = p.rstrip(TAIL)
                if len(head) < len(p) and head.isalpha():  # letters, then marks: a pre-token ends between
                    out.append(get(head) or self._learn(memo, head, " " + head))
                    tail = p[len(head):]
                    out.append(tails.get(tail) or self._learn(tails, tail, tail))
                else:
                    out.append(self._learn(memo, p, s))
        if held:
            out.append(self.encode(held))
        return out

    def _learn(self, memo: dict, key: str, text: str) -> object:
        v = self.old.get(key) if memo is self.memo else None
        if v is None:
            v = self.encode(text)
        self._keep(memo, key, v)
        return v

    def _keep(self, memo: dict, key: str, v: object) -> None:
        if len(self.memo) + len(self.tails) >= self.limit:
            self.old = dict(self.memo)
            self.memo.clear()
            self.tails.clear()
        memo[key] = v


def blank_end(part: str) -> bool:
    return not part or part[-1].isspace()


class BatchPieces(Pieces):
    """Pieces with bytes as values; ``many(texts)`` encodes the parts that are new in all of the texts together.

    ``encode_many(parts)`` gives the values of parts that each begin with a space or newline and end with another
    character, so they may stand one after the other in one text.  A part is named as in ``values``, one with more
    white space before it by its whole text, which holds a space or newline after its first character as no other name does.
    """

    def __init__(self, encode: Callable[[str], bytes], encode_many: Callable[[list[str]], list[bytes]], limit: int = MEMO_PARTS):
        super().__init__(encode, limit)
        self.encode_many, self.newline = encode_many, encode("\n")

    def many(self, texts: list[str]) -> list[bytes]:
        """The joined values of each text."""
        get, rows, new = self.memo.get, [], {}
        for text in texts:
            parts = text.replace("\n", " \n").split(" ")
            if parts[0] and not parts[0][0].isspace():
                parts[0] = "\n" + parts[0]  # a newline is a pre-token of its own there, so it is dropped again
            values = list(map(get, parts))
            if not parts[0]:
                values[0] = b""
            elif parts[0][0] != "\n":  # other white space begins the text
                values[0] = None if blank_end(parts[0]) else self.encode(parts[0])
            lost = [i for i, v in enumerate(values) if v is None]
            names = [parts[i] for i in lost]
            if any(map(blank_end, names)):
                lost, names = self._joined(parts, values, lost)
            new.update(dict.fromkeys(names))
            rows.append((values, lost, names, text[:1]))
        now = self._learn_all(new)
        out = []
        for values, lost, names, first in rows:
            for i, name in zip(lost, names):
                values[i] = now[name]
            blob = b"".join(values)
            out.append(blob[len(self.newline):] if first and not first.isspace() else blob)
        return out

    def _joined(self, parts: list[str], values: list, lost: list[int]) -> tuple[list[int], list[str]]:
        """The lost places and their names, where white space goes to the part behind it; white space at an end is encoded at once."""
        left, names, done, n = [], [], 0, len(parts)
        for i in lost:
            if i < done:
                continue
            if not blank_end(parts[i]):
                left.append(i)
                names.append(parts[i])
                continue
            done = i + 1
            while done < n and blank_end(parts[done]):
                done += 1
            done = min(done + 1, n)
            whole = "".join([p if p[:1] == "\n" or not k else " " + p for k, p in enumerate(parts[i:done], i)])
            values[i:done] = [b""] * (done - i)
            if whole[-1].isspace() or whole[0] not in " \n":
                values[i] = self.encode(whole)
            else:
                values[i] = self.memo.get(whole)
                if values[i] is None:
                    left.append(i)
                    names.append(whole)
        return left, names

    def _learn_all(self, new: dict[str, None]) -> dict[str, bytes]:
        """Values of new parts by their names."""
        before, kept, tails, now, asked, marked = self.old.get, self.memo.get, self.tails.get, {}, {}, []
        for p in new:
            v = before(p)
            if v is not None:
                now[p] = v
                continue
            if p[-1] in TAIL:
                head = p.rstrip(TAIL)
                if head.isalpha():  # letters, then marks: a pre-token ends between
                    v = kept(head) or before(head)
                    marked.append((p, head, v))
                    if v is None:
                        asked[head] = " " + head
                    continue
            asked[p] = p if p[0] in " \n" else " " + p
        now.update(zip(asked, self.encode_many(list(asked.values()))))
        for p, head, v in marked:
            mark = p[len(head):]
            now[p] = (now[head] if v is None else v) + (tails(mark) or self._learn(self.tails, mark, mark))
        if len(self.memo) + len(now) > self.limit:
            self.old = dict(self.memo)
            self.memo.clear()
        self.memo.update(islice(now.items(), self.limit))
        return now
