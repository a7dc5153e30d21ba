"""Token ids of whole texts by the tokenizers library, as little-endian unsigned 32-bit integers.

Most of a text's chunks (the characters between two spaces or line ends) have been seen before, so the library encodes
each distinct chunk once and the ids of a text are joined from a bounded table. Chunks that the table lacks are joined to
one string, since a call costs the library more than a word does, and its ids are cut where the chunks end. No tokenizer
merges over the edge between a visible character and white space; texts with white space other than the space and the
line end, or with the string of a special token, are encoded whole.

A worker process keeps one encoder for all its tasks, and the library's threads are off: Spark has a task for each core.
"""

from __future__ import annotations

import os
import re
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

END_ID = 2
#: Distinct chunks kept in a worker process: those seen last. Chunks in one call, and texts that share one.
CHUNKS, CALL, TEXTS = 400_000, 8192, 64
_ODD_SPACE = re.compile(r"[^\S \n]")
_WITH_SPACE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Stands between chunks in a call; chunks that hold it are encoded on their own.
_BETWEEN = "\x01"
#: A chunk of a letter and these is the chunk without them and they: no tokenizer merges the two.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def kept_in_process(name: str, make: Callable[[], object]) -> object:
    """What make() gave the first time in this process: tasks of one worker share it, whatever their functions' globals."""
    held = sys.modules.setdefault("_corpusmill_worker", types.ModuleType("_corpusmill_worker")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def encoder(path: str, spaces: bool, special: bool = True, chunks: int = CHUNKS) -> Callable[[list[str | None]], list[bytes]]:
    """encode(texts) gives the ids of each (null: empty), without an end id. spaces: white space is part of the ids.

    special: the strings of special tokens stand for them, as the library has it; otherwise they are ordinary text.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept_in_process(f"encoder {path} {spaces} {special} {chunks}", lambda: _encoder(path, spaces, special, chunks))


def _encoder(path: str, spaces: bool, special: bool, chunks: int) -> Callable[[list[str | None]], list[bytes]]:
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = not special
    names = [x.content for x in library.get_added_tokens_decoder().values()] if special else []
    vocabulary = {i: t for t, i in library.get_vocab(with_added_tokens=False).items()}
    known: dict[str, bytes] = {}
    before: dict[str, bytes] = {}
    split = _WITH_SPACE.findall if spaces else str.split

    def ids_of(text: str) -> np.ndarray:
        return np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def cut(parts: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        raw, ends = ids.tobytes(), (ends * 4).tolist()
        known.update(zip(parts, [raw[a:b] for a, b in zip([0, *ends], ends)], strict=True))

    def alone(parts: list[str]) -> None:
        found = library.encode_batch_fast(parts, add_special_tokens=False)
        known.update((p, np.array(x.ids, "<u4").tobytes()) for p, x in zip(parts, found, strict=True))

    if spaces:  # byte-level: the ids' lengths in bytes say where a chunk ends
        size = np.zeros(max(vocabulary) + 1, np.int64)
        size[list(vocabulary)] = [len(t) for t in vocabulary.values()]

        def learn(parts: list[str]) -> None:
            ids, stops = ids_of("".join(parts)), np.cumsum(list(map(len, map(str.encode, parts))))
            at = np.concatenate(([0], np.cumsum(size[ids])))
            ends = np.searchsorted(at, stops)
            cut(parts, ids, ends) if at[-1] == stops[-1] and (at[ends] == stops).all() else alone(parts)

        together = lambda p: p[0] in " \n" and p[-1] not in " \n"
    else:  # a word of letters is one id with a word end, or several of which the last has it
        stop = np.zeros(max(vocabulary) + 1, bool)
        stop[[i for i, t in vocabulary.items() if t.endswith("</w>")]] = True
        between = int(ids_of(_BETWEEN)[0])

        def learn(parts: list[str]) -> None:
            if words := [p for p in parts if p.isalpha()]:
                ids = ids_of(" ".join(words))
                ends = np.flatnonzero(stop[ids]) + 1
                cut(words, ids, ends) if len(ends) == len(words) and ends[-1] == len(ids) else alone(words)
            if others := [p for p in parts if not p.isalpha()]:
                ids = ids_of(f" {_BETWEEN} ".join([*others, ""]))
                marks = np.flatnonzero(ids == between)
                if len(marks) == len(others):
                    ends = marks - np.arange(len(marks))
                    cut(others, ids[ids != between], ends)
                else:
                    alone(others)

        together = lambda p: _BETWEEN not in p

    def learn_all(new: set[str]) -> None:
        """Chunks that neither table has. Of those with closing marks the word is learnt, if it isn't known either."""
        whole, tailed, bases = [], [], set()
        for p in new:
            if p[-1] in _TAIL and together(p) and (base := p.rstrip(_TAIL)) and base[-1] < "\u0250" and base[-1].isalpha() and base[-1] != "\u0130":  # its lower case ends in a mark
                tailed.append((p, base, p[len(base) :]))
                bases.add(base)
            else:
                whole.append(p)
        odd = [p for p in whole if not together(p)]
        todo = whole if not odd else [p for p in whole if together(p)]
        for base in bases.difference(known):
            if base in before:
                known[base] = before[base]
            elif base not in new:
                todo.append(base)
        odd += {tail for _, _, tail in tailed}.difference(known)
        for k in range(0, len(todo), CALL):
            learn(todo[k : k + CALL])
        for k in range(0, len(odd), CALL):
            alone(odd[k : k + CALL])
        known.update([(p, known[base] + known[tail]) for p, base, tail in tailed])

    def encode(texts: list[str | None]) -> list[bytes]:
        nonlocal known, before
        out: list[bytes] = []
        for at in range(0, len(texts), TEXTS):
            some = texts[at : at + TEXTS]
            parts = [[] if not t or _ODD_SPACE.search(t) or any(n in t for n in names) else split(t) for t in some]
            if len(known) > chunks // 2:
                known, before = {}, known
            new = set().union(*parts).difference(known)
            again = [p for p in new if p in before]
            known.update((p, before[p]) for p in again)
            learn_all(new.difference(again))
            out += [b"".join(map(known.__getitem__, own)) if own else ids_of(t).tobytes() if t else b"" for t, own in zip(some, parts, strict=True)]
        return out

    return encode


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
