"""Settings of the retrieval plans, in one place."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """k: hits of a query; k1 and b: BM25; fusion: the constant of rank fusion;
    trade: relevance against likeness in re-ranking; budget: tokens of a packed
    context; chunk and stride: tokens of a passage and from one to the next;
    neighbours: of a vector; long_turn: characters from which a turn is
    summarized first; window: tokens among which words count as near; feedback,
    expansion and own: hits and terms of a relevance model, and the question's
    share in it; enough and retrievals: the share of a question's words that an
    answer holds, and retrievals until it is given up; edits and spellings: of
    a word that no document holds; files_at_once: of a stream's batch; pause:
    seconds that end a session."""

    k: int = 10
    k1: float = 1.2
    b: float = 0.75
    fusion: int = 60
    picks: int = 5
    trade: float = 0.7
    budget: int = 2000
    chunk: int = 64
    stride: int = 48
    neighbours: int = 5
    long_turn: int = 400
    window: int = 8
    feedback: int = 10
    expansion: int = 10
    own: float = 0.5
    enough: float = 0.6
    retrievals: int = 3
    edits: int = 1
    spellings: int = 3
    files_at_once: int = 64
    pause: int = 43_200

    @classmethod
    def load(cls, path: str) -> Settings:
        """Settings from a JSON object; what it lacks keeps its default, and a
        name that is no setting is an error."""
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        if unknown := set(given) - {f.name for f in fields(cls)}:
            raise ValueError(f"no such settings: {', '.join(sorted(unknown))}")
        return cls(**given)
