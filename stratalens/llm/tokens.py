"""Word-level use of a `tokenizers` file: exact for tokenizers that drop white space and never join across it."""

from __future__ import annotations

import hashlib
import json

from .common import ChunkTable, ship, worker_table

ship(__name__)


def load_file(path: str) -> tuple[bytes, str]:
    """The vocabulary file's bytes (sent to the workers) and its digest, which names the tokenizer's version."""
    with open(path, "rb") as f:
        raw = f.read()
    return raw, hashlib.sha256(raw).hexdigest()


def splits_at_spaces(raw: bytes) -> bool:
    """Whether encoding each run between ASCII white space alone gives the same ids as encoding the whole text.

    So it is if white space is normalised to one space and then removed before the merges, no added token holds or strips
    white space, and nothing is added by position. NFC composes nothing across a space, lower-casing is by character.
    """
    spec = json.loads(raw)
    steps = (spec.get("normalizer") or {}).get("normalizers") or [spec.get("normalizer") or {}]
    if any(s.get("type") not in ("NFC", "Lowercase", "Replace") for s in steps):
        return False
    if any(s["type"] == "Replace" and (s["pattern"], s["content"]) != ({"Regex": "\\s+"}, " ") for s in steps):
        return False
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    first = pre[0]
    dropped = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and first.get("pattern") == {"Regex": WORDS_ONLY}
    bare = all(p.get("type") == "ByteLevel" and not p.get("add_prefix_space") and not p.get("use_regex") for p in pre[1:])
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
    return dropped and bare and added and not spec.get("truncation") and not spec.get("padding") and not spec.get("post_processor")


#: Fixed value: the split pattern of word_bpe_49k.json, none of whose alternatives matches white space.
WORDS_ONLY = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def encoder(raw: bytes):
    """A function from a list of texts to their id lists, by the library, without special tokens added."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tk = Tokenizer.from_buffer(raw)
    tk.no_truncation()
    tk.no_padding()
    batch = getattr(tk, "encode_batch_fast", tk.encode_batch)
    return lambda texts: [e.ids for e in batch(texts, add_special_tokens=False)]


#: Letters, numbers and white space among the first 256 code points, as the pattern above sees them.
_LATIN = "'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\x09-\\x0d\x20\x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+"


def cutter():
    """A function from a text to chunks that may be encoded alone.

    A text of the first 256 code points is lower-cased and cut into the tokenizer's own words, as str (NFC changes nothing
    there); one with others, or with what may be an added token, is cut at ASCII white space only, as bytes.
    """
    import re

    words = re.compile(_LATIN).findall

    def cut(text: bytes) -> list:
        if b"<|" not in text:
            if text.isascii():
                return words(text.decode("ascii").lower())
            try:
                s = text.decode()
                s.encode("latin-1")
                return words(s.lower())
            except UnicodeEncodeError:
                pass
        return text.split()

    return cut


def id_bytes_table(raw: bytes, dtype: str):
    """The chunk table word -> its ids as bytes of `dtype`, and the function that cuts a text into its chunks."""
    table = worker_table((hashlib.sha256(raw).hexdigest(), dtype), lambda: _new_table(raw, dtype))
    return table, table.cut


def _new_table(raw: bytes, dtype: str) -> ChunkTable:
    import numpy as np

    encode = encoder(raw)
    if not splits_at_spaces(raw):
        table = ChunkTable(lambda chunks: [np.asarray(x, dtype).tobytes() for x in encode(chunks)])
        table.cut = lambda b: [b.decode("utf-8", "replace")]
        return table
    spec = json.loads(raw)
    suffix, width = spec["model"].get("end_of_word_suffix") or "", np.dtype(dtype).itemsize
    ends = np.zeros(1 + max(max(spec["model"]["vocab"].values()), *(t["id"] for t in spec["added_tokens"])), bool)
    ends[[i for w, i in spec["model"]["vocab"].items() if suffix and w.endswith(suffix)]] = True

    def make(chunks: list) -> list[bytes]:
        """Many of the tokenizer's own words in one call, told apart by the tokens that end words; other chunks go alone."""
        out: list = [None] * len(chunks)
        plain = [i for i, c in enumerate(chunks) if isinstance(c, str)]
        parts = [plain[k : k + 50] for k in range(0, len(plain), 50)]
        for k in range(0, len(parts), 100):
            for part, ids in zip(parts[k : k + 100], encode([" ".join([chunks[i] for i in p]) for p in parts[k : k + 100]]), strict=True):
                at = (np.flatnonzero(ends[ids]) + 1).tolist()
                if len(at) == len(part) and at[-1] == len(ids):
                    joined = np.asarray(ids, dtype).tobytes()
                    for i, a, b in zip(part, [0, *at[:-1]], at, strict=True):
                        out[i] = joined[a * width : b * width]
        rest = [i for i, x in enumerate(out) if x is None]
        alone = [c if isinstance(c := chunks[i], str) else c.decode("utf-8", "replace") for i in rest]
        for i, ids in zip(rest, encode(alone), strict=True):
            out[i] = np.asarray(ids, dtype).tobytes()
        return out

    table = ChunkTable(make, 1_000_000)
    table.cut = cutter()
    return table
