"""Word-piece lengths of texts by a linear longest-match automaton.

A trie of initial and continuing pieces gets failure links and, for each link,
the number of pieces that following it emits. One left-to-right walk over a word
then adds up the length of its greedy longest-match encoding; no piece is built
and no position is read twice. A word that cannot be covered counts as one
unknown piece.

Defined cases: a NULL text has no words and no pieces; words are runs between
ASCII white space, of any length; repeated rows give repeated results; an empty
table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from tidemark.llm.text_map import map_texts

#: Words whose length a task remembers; the memory starts anew when it is full.
REMEMBERED = 200_000


class LongestMatch:
    """Counts of greedy longest-match pieces. `initial` begin a word, `continuing` go on in it."""

    def __init__(self, initial: Iterable[str], continuing: Iterable[str]):
        self.children: list[dict[str, int]] = [{}, {}]  # 0 begins a word, 1 goes on
        piece_ends = set()
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                node = root
                for char in piece:
                    step = self.children[node]
                    if char not in step:
                        step[char] = len(self.children)
                        self.children.append({})
                    node = step[char]
                if node != root:
                    piece_ends.add(node)
        self.link: list[int] = [-1] * len(self.children)
        self.popped = [0] * len(self.children)
        level = [0, 1]
        while level:
            following = []
            for node in level:
                for char, child in self.children[node].items():
                    following.append(child)
                    if child in piece_ends:
                        self.link[child], self.popped[child] = 1, 1
                        continue
                    back, popped = self.link[node], self.popped[node]
                    while back >= 0 and char not in self.children[back]:
                        popped += self.popped[back]
                        back = self.link[back]
                    if back >= 0:
                        self.link[child], self.popped[child] = self.children[back][char], popped
            level = following

    def count(self, word: str) -> int:
        """Pieces of a word, 0 if it cannot be covered."""
        children, link, popped = self.children, self.link, self.popped
        node = n = 0
        for char in word:
            while char not in children[node]:
                if link[node] < 0:
                    return 0
                n += popped[node]
                node = link[node]
            node = children[node][char]
        while node != 1:
            if link[node] < 0:
                return 0
            n += popped[node]
            node = link[node]
        return n


def piece_vocabulary(model_path: str, marker: str = "▁") -> tuple[list[str], list[str]]:
    """Initial and continuing pieces of a sentencepiece vocabulary file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    plain = [p for p in pieces if marker not in p]
    return [p[1:] for p in pieces if p.startswith(marker) and marker not in p[1:] and len(p) > 1], plain


def token_counts(docs: DataFrame, initial: list[str], continuing: list[str], id_col: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """`id`, n_words, n_tokens (an uncovered word is one), n_unknown."""
    def start():
        matcher, known = LongestMatch(initial, continuing), {}

        def lengths(value: str | None) -> tuple[int, int, int]:
            words = (value or "").encode("utf-8", "surrogatepass").split()
            if len(known) > REMEMBERED:
                known.clear()
            counts = []
            for word in words:
                n = known.get(word)
                if n is None:
                    n = known[word] = matcher.count(word.decode("utf-8", "surrogatepass"))
                counts.append(n)
            unknown = counts.count(0)
            return len(words), sum(counts) + unknown, unknown

        names = ("n_words", "n_tokens", "n_unknown")
        return lambda texts: dict(zip(names, zip(*map(lengths, texts))))

    return map_texts(docs, id_col, text, start, "n_words long, n_tokens long, n_unknown long")
