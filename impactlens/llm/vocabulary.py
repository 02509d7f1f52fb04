"""A sentencepiece vocabulary of merge type, read from its model file, and the units texts fall into."""

from __future__ import annotations

import re
from functools import cached_property, lru_cache

SPACE = "▁"
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Vocabulary:
    """Pieces, their ranks (0 merges first) and their kinds.

    Only what the operators rely on is accepted: merge type, byte fallback, text taken as it is, and
    no piece with a blank behind another character, so that units can be encoded one by one.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        processor = SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto.FromString(processor.serialized_model_proto())
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        normal, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != sentencepiece_model_pb2.TrainerSpec.BPE or not trainer.byte_fallback:
            raise ValueError("a merge-type vocabulary with byte fallback is needed")
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces:
            raise ValueError("a vocabulary that takes texts as they are is needed")
        self.prefix = SPACE if normal.add_dummy_prefix else ""
        self.unk_surface = trainer.unk_surface
        self.pieces = [p.piece for p in model.pieces]
        self.scores = [p.score for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.CONTROL, self.UNKNOWN, self.BYTE = kind.CONTROL, kind.UNKNOWN, kind.BYTE
        if any(k not in (kind.NORMAL, kind.CONTROL, kind.UNKNOWN, kind.BYTE) for k in self.kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        self.begin, self.end, self.unknown = processor.bos_id(), processor.eos_id(), processor.unk_id()
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == kind.NORMAL}
        order = sorted({self.scores[i] for i in self.ids.values()}, reverse=True)
        place = {s: r for r, s in enumerate(order)}
        self.rank = {p: place[self.scores[i]] for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == kind.BYTE}
        self.characters = {p for p in self.ids if len(p) == 1}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or any(not set(p) <= self.characters for p in self.ids):
            raise ValueError("a vocabulary with pieces inside words, made of its own characters, is needed")

    def units(self, text: str) -> list[str]:
        """The text with blanks marked, cut in front of every run of blanks."""
        return UNIT.findall(self.prefix + text.replace(" ", SPACE)) if text else []

    @cached_property
    def strange(self) -> re.Pattern:
        """Characters the vocabulary has no piece for."""
        return re.compile(f"[^{''.join(map(re.escape, sorted(self.characters)))}]")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
