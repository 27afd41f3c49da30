"""Chat formatting of typed content parts.

A conversation is its rows in the order of (turn, role, content); each row's content is an
array of typed parts. A visitor walks the parts in order and flattens them into one string:

- text parts stand as they are, except that ``<|`` becomes ``< |``, also where one part ends with
  ``<`` and what follows begins with ``|``, so no text can pose as a placeholder or as a turn mark;
- image, audio and document parts become ``<|image_1|>``, ``<|audio_1|>``, ``<|document_1|>``,
  numbered by type through the conversation, and leave an attachment reference (number, type,
  url, place of the placeholder in the string, expanded tokens);
- a part of any other type becomes ``<|unknown_1|>`` with no tokens of its own.

Expanded tokens, what a model sees in place of the placeholder: an image has one for each
28 x 28 patch, audio 12.5 a second, a document 512 a page, each rounded up, and two marks
around them. Missing, negative, infinite and NaN sizes count as 0; counts have 64 bits, and one
that is larger is the largest of those. Text counts in tokens of a byte-level BPE, part by part.

Every turn is ``<|role|>\\n`` + parts + ``<|end|>\\n``; a role loses its characters ``<``, ``|``
and ``>``.

Defined results: rows with a NULL conv_id belong to no conversation and are left out. A NULL
or empty role is ``unknown``. A NULL or empty content, and a NULL text, add nothing between the marks.
Repeated rows are repeated turns. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarine.llm import secrets

PART = "struct<type: string, text: string, url: string, width: int, height: int, seconds: double, pages: int>"
ATTACHMENT = "struct<number: int, type: string, url: string, place: bigint, tokens: bigint>"
RESULT = f"struct<prompt: string, turns: int, attachments: array<{ATTACHMENT}>, text_tokens: bigint, attachment_tokens: bigint>"
PATCH, AUDIO_RATE, PAGE_TOKENS, MARKS = 28, 12.5, 512, 2
MOST = (1 << 63) - 1
_MARKS = str.maketrans("", "", "<|>")


@dataclass
class Flattener:
    """Visitor of the parts of one conversation: visit_<type> for each type of part."""

    encoding: object
    out: list[str] = field(default_factory=list)
    size: int = 0
    text_tokens: int = 0
    attachments: list[dict] = field(default_factory=list)
    numbers: dict[str, int] = field(default_factory=dict)
    #: Whether a text part ended with ``<`` just before.
    pending: bool = False

    def write(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)
        self.pending = False

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part['type']}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        text = (part["text"] or "").replace("<|", "< |")
        if not text:
            return
        if self.pending and text[0] == "|":
            text = " " + text
        self.text_tokens += len(self.encoding.encode_ordinary(text))
        self.write(text)
        self.pending = text[-1] == "<"

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil(max(part[k] or 0, 0) / PATCH) for k in ("width", "height"))
        self.attach("image", part, across * down + MARKS)

    def visit_audio(self, part: dict) -> None:
        seconds = part["seconds"] if part["seconds"] is not None and 0 < part["seconds"] < math.inf else 0.0
        self.attach("audio", part, math.ceil(min(seconds * AUDIO_RATE, MOST)) + MARKS)

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, max(part["pages"] or 0, 0) * PAGE_TOKENS + MARKS)

    def visit_unknown(self, part: dict) -> None:
        self.attach("unknown", part, 0)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        number = self.numbers[kind] = self.numbers.get(kind, 0) + 1
        self.attachments.append({"number": number, "type": kind, "url": part["url"], "place": self.size, "tokens": min(tokens, MOST)})
        self.write(f"<|{kind}_{number}|>")

    def turn(self, role: str | None, content: list | None) -> None:
        self.write(f"<|{(role or '').translate(_MARKS) or 'unknown'}|>\n")
        for part in content or ():
            self.visit(part)
        self.write("<|end|>\n")


def flatten(turns: list[dict], encoding) -> dict:
    seen = Flattener(encoding)
    for turn in turns:
        seen.turn(turn["role"], turn["content"])
    return {
        "prompt": "".join(seen.out), "turns": len(turns), "attachments": seen.attachments,
        "text_tokens": seen.text_tokens, "attachment_tokens": min(sum(a["tokens"] for a in seen.attachments), MOST),
    }


_RESULT = pa.struct(
    [
        ("prompt", pa.string()),
        ("turns", pa.int32()),
        (
            "attachments",
            pa.list_(pa.struct([("number", pa.int32()), ("type", pa.string()), ("url", pa.string()), ("place", pa.int64()), ("tokens", pa.int64())])),
        ),
        ("text_tokens", pa.int64()),
        ("attachment_tokens", pa.int64()),
    ]
)


def format_conversations(turns: DataFrame, path: str = secrets.VOCABULARY) -> DataFrame:
    """(conv_id, prompt, turns, attachments, text_tokens, attachment_tokens) of turns(conv_id, turn, role, content)."""
    ranks = secrets.vocabulary(path)

    def formatted(conversations: pa.Array) -> pa.Array:
        encoding = secrets.encoder(ranks)
        return pa.array([flatten(c, encoding) for c in conversations.to_pylist()], _RESULT)

    rows = F.struct(F.col("turn"), F.col("role"), F.col("content"))
    whole = turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(rows)).alias("_turns"))
    return whole.select("conv_id", F.arrow_udf(formatted, RESULT).asNondeterministic()("_turns").alias("_f")).select("conv_id", "_f.*")


def typed(conversations: DataFrame) -> DataFrame:
    """Turns of plain text with typed content: each line a text part.

    The tables hold no attachments, so lines of user turns are followed by one, by
    (conv_id + turn + line) modulo 4: image, audio, document, none. Its size follows the
    line's length.
    """
    blank = {"type": "string", "text": "string", "url": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}

    def part(**given):
        return F.struct(*(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in blank.items()))

    def parts(line, k):
        size = F.length(line)
        which = F.pmod(F.coalesce("conv_id", F.lit(0)) + F.coalesce("turn", F.lit(0)) + k, F.lit(4))
        url = F.concat(F.lit("media://"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit("/"), F.col("turn").cast("string"), F.lit("/"), k.cast("string"))
        extra = (
            F.when(which == 0, F.array(part(type=F.lit("image"), url=url, width=size * 8, height=size * 4)))
            .when(which == 1, F.array(part(type=F.lit("audio"), url=url, seconds=size / 10)))
            .when(which == 2, F.array(part(type=F.lit("document"), url=url, pages=F.ceil(size / 100))))
            .otherwise(F.array().cast(f"array<{PART}>"))
        )
        text = F.array(part(type=F.lit("text"), text=F.concat(line, F.lit("\n"))))
        return F.concat(text, F.when(F.col("role") == "user", extra).otherwise(F.array().cast(f"array<{PART}>")))

    content = F.flatten(F.transform(F.split("text", "\n"), parts))
    return conversations.select("conv_id", "turn", "role", content.alias("content"))


def query(spark, sf_dir: str) -> DataFrame:
    return format_conversations(typed(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
