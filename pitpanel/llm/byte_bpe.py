"""Byte-level BPE files of the tokenizers library, encoded by tiktoken.

Both libraries give the same ids if the file says what is assumed here: no normaliser, the plain
byte-level pre-tokenizer, merges in the order of the ids. A file that says otherwise is refused.
Very long runs of white space, on which the pattern would recurse too deeply, are merged by
themselves: the pattern makes one piece of such a run but for its last character, which may
belong to the word after it.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: The pattern of byte-level BPE (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters with the property White_Space (fixed values).
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = re.compile(f"[{WHITE_SPACE}]{{4096,}}")


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in the file: printable ones for themselves, others from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}


def assumed(parts: dict) -> str | None:
    """What in the file is not as assumed, if anything."""
    model, before = parts["model"], parts.get("pre_tokenizer") or {}
    if parts.get("normalizer") is not None:
        return "a normaliser"
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return "another pre-tokenizer"
    if model.get("type") != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or any(
            model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix")):
        return "another model"
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [model["vocab"].get(a + b) for a, b in merges]
    if None in order or order != sorted(order):
        return "merges in another order than the ids"
    return None


class ByteLevelBPE:
    """Ids of texts, without added tokens; ``special`` strings in a text are its tokens, or plain text."""

    def __init__(self, tokenizer_file: str):
        import tiktoken

        with open(tokenizer_file, encoding="utf-8") as f:
            parts = json.load(f)
        wrong = assumed(parts)
        if wrong:
            raise ValueError(f"{tokenizer_file}: {wrong}")
        byte = byte_characters()
        self.special = {t["content"]: t["id"] for t in parts.get("added_tokens", ())}
        self.tokens = {k: bytes(byte[c] for c in token) for token, k in parts["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks={v: k for k, v in self.tokens.items()}, special_tokens={})
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def plain(self, text: str) -> np.ndarray:
        """Ids of the text, special strings being plain text."""
        out, at = [], 0
        for run in LONG_RUN.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += [self.fast.encode_to_numpy(text[at:run.start()], disallowed_special=()),
                    np.array(self.fast._core_bpe.encode_single_piece(text[run.start():end].encode("utf-8")), np.uint32)]
            at = end
        if not out:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.concatenate([*out, self.fast.encode_to_numpy(text[at:], disallowed_special=())])

    def ids(self, text: str) -> np.ndarray:
        """Ids of the text, special strings being their tokens."""
        if not self.cut or not any(s in text for s in self.special):
            return self.plain(text)
        return np.concatenate([np.array([self.special[part]], np.uint32) if part in self.special else self.plain(part)
                               for part in self.cut.split(text)])
