"""Embeddings: a deterministic one for tests and benchmarks, and a wrapper that sends Arrow batches to any provider."""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.schema import SETTINGS


def mock_embedding(c: Column, dimension: int = SETTINGS.dimension) -> Column:
    """Unit vector from the SHA-256 of the text: component i is ((b[i mod 32] + 17 i) mod 256) / 255 - 1/2 before it is scaled. Blank: zeros.

    The digest is a built-in function; only its 32 bytes go to Python, where a batch of them becomes a matrix: as functions of arrays the components took
    a third of a millisecond for each text. The unscaled components repeat every 256 places, so for dimensions that are multiples of 256 cosines are those of
    the first 256.
    """

    @F.arrow_udf("array<double>")
    def scaled(digests: pa.Array) -> pa.Array:
        return _scaled(digests, dimension)

    return F.when(blank(c), F.array_repeat(F.lit(0.0), dimension)).otherwise(scaled(F.unhex(F.sha2(F.coalesce(c, F.lit("")), 256))))


def _scaled(digests: pa.Array, dimension: int) -> pa.Array:
    """The unit vectors of digests. Squares are added in the order of the components."""
    held = np.frombuffer(b"".join(digests.to_pylist()), "u1").reshape(-1, 32)
    out = np.empty((len(held), dimension))
    places = np.arange(dimension)
    numbers = np.arange(256) / 255.0 - 0.5
    for a in range(0, len(held), 1024):
        raw = numbers[held[a : a + 1024].T[places % 32] + (17 * places % 256).astype("u1")[:, None]]  # bytes wrap at 256
        total = np.zeros(raw.shape[1])
        for row in raw:
            total += row * row
        out[a : a + 1024] = (raw / np.sqrt(total)).T
    return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype="i4") * dimension), pa.array(out.ravel()))


def blank(c: Column) -> Column:
    """Null, empty or white space alone; looks no further than the first other character."""
    return ~F.coalesce(F.rlike(c, F.lit(r"(?U)\S")), F.lit(False))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is worked out once for each row however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """a at length 1; NaN components for the zero vector, so that its scores are NaN."""

    def scaled(n: Column) -> Column:
        return F.transform(a, lambda x: F.when(n == 0, F.lit(float("nan"))).otherwise(x.cast("double") / F.when(n == 0, 1.0).otherwise(n)))

    return let(norm(a), scaled)


def checked(a: Column, dimension: int) -> Column:
    return F.when(F.assert_true(F.size(a) == dimension, F.concat(F.lit(f"Embedding dimension mismatch: expected {dimension}, got "), F.size(a).cast("string"))).isNull(), a)


class QuotaExceeded(RuntimeError):
    """The provider still refuses after the last retry."""

    status_code = 429

    def __init__(self, provider: str, delay: float):
        seconds = str(max(0, math.ceil(delay)))
        super().__init__(f"{provider} embedding quota was exceeded. Retry after {seconds} seconds.")
        self.headers = {"Retry-After": seconds}


#: How providers word a wish to wait.
WISHES = (
    r"retry\s+in\s+([0-9]+(?:\.[0-9]+)?)s",
    r"retryDelay['\"]?\s*:\s*['\"]([0-9]+(?:\.[0-9]+)?)s",
)
#: What providers say when they are asked too often: one word alone, or the code with one of two others.
EXHAUSTED, CODE, LIMITS = "resource_exhausted", "429", ("quota", "rate limit")


def _too_often(message: str) -> bool:
    said = message.lower()
    return EXHAUSTED in said or (CODE in said and any(w in said for w in LIMITS))



@dataclass(frozen=True)
class Refusal:
    """What an exception and all that led to it tell: messages, status codes, and the values of retry-after headers."""

    messages: tuple[str, ...]
    codes: frozenset
    headers: tuple

    @classmethod
    def of(cls, error: BaseException) -> Refusal:
        told = {id(error): error}
        newest = error
        while (newest := newest.__cause__ or newest.__context__) is not None and id(newest) not in told:
            told[id(newest)] = newest
        responses = [r for e in told.values() if (r := getattr(e, "response", None)) is not None]
        codes = frozenset(getattr(x, "status_code", None) for x in (*told.values(), *responses))
        headers = (dict(getattr(r, "headers", None) or {}) for r in responses)
        return cls(tuple(map(str, told.values())), codes, tuple(v for h in headers for k, v in h.items() if k.lower() == "retry-after"))

    @property
    def too_often(self) -> bool:
        return 429 in self.codes or any(map(_too_often, self.messages))

    def wait(self, usual: float, most: float) -> float:
        """The longest wait that is asked for, else the usual one; `most` at most."""
        numbers = [str(h) for h in self.headers if re.fullmatch(r"\s*[0-9]+(?:\.[0-9]+)?\s*", str(h))]
        numbers += [x for m in self.messages for wish in WISHES for x in re.findall(wish, m, re.IGNORECASE)]
        return min(most, max(map(float, numbers), default=usual))


def with_retries(call: Callable, retries: int = SETTINGS.max_retries, sleep: Callable = time.sleep, provider: str = "The provider's", base: float = SETTINGS.retry_base_seconds, most: float = SETTINGS.retry_max_seconds):
    """call(), again after a wait as long as the provider is asked too often; other errors pass. The usual wait doubles each time."""
    usual = [base * 2**i for i in range(retries + 1)]
    while True:
        try:
            return call()
        except Exception as e:
            refusal = Refusal.of(e)
            if not refusal.too_often:
                raise
            pause = refusal.wait(usual.pop(0), most)
            if not usual:
                raise QuotaExceeded(provider, pause) from e
        sleep(pause)


def embed_texts(texts: list[str], embed: Callable, dimension: int, **how) -> list[list[float]]:
    """Vectors in order. Only texts that are not blank are sent, in one call; the others get zeros. A wrong count or length is an error."""
    sent = [t for t in texts if (t or "").strip()]
    vectors = iter(with_retries(lambda: embed(sent), **how) if sent else [])
    out = [next(vectors, None) if (t or "").strip() else [0.0] * dimension for t in texts]
    if any(v is None for v in out) or next(vectors, None) is not None:
        raise RuntimeError("the provider gave another number of vectors than texts")
    for v in out:
        if len(v) != dimension:
            raise RuntimeError(f"Embedding dimension mismatch: expected {dimension}, got {len(v)}.")
    return out


def provider_embedding(c: Column, make: Callable[[], Callable], dimension: int = SETTINGS.dimension, **how) -> Column:
    """Vectors from a provider. Each task has a client of its own from make(), for all of its Arrow batches; each batch is one call."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make()
        for texts in batches:
            yield pd.Series(embed_texts(texts.tolist(), client, dimension, **how))

    return run(c)


def openai_client(api_key: str | None, model: str = "text-embedding-3-small") -> Callable[[], Callable]:
    """For provider_embedding. The key is asked for at once; the package only on the workers."""
    if not api_key:
        raise RuntimeError("OPENAI_API_KEY is required for the OpenAI embedding provider.")

    def make():
        from openai import OpenAI

        client = OpenAI(api_key=api_key)
        return lambda texts: [d.embedding for d in client.embeddings.create(model=model, input=texts).data]

    return make


def gemini_client(api_key: str | None, model: str = "gemini-embedding-001", dimension: int = SETTINGS.dimension) -> Callable[[], Callable]:
    if not api_key:
        raise RuntimeError("GEMINI_API_KEY is required for the Gemini embedding provider.")

    def make():
        from google import genai

        client = genai.Client(api_key=api_key)
        return lambda texts: [e.values for e in client.models.embed_content(model=model, contents=texts, config={"output_dimensionality": dimension}).embeddings]

    return make


def embedder(provider: str, api_key: str | None = None, **how) -> Callable[[Column], Column]:
    """The embedding column for a provider's name: mock, openai or gemini."""
    provider = provider.lower()
    if provider == "mock":
        return lambda c: mock_embedding(c, how.get("dimension", SETTINGS.dimension))
    if provider not in ("openai", "gemini"):
        raise ValueError(f"Unsupported embedding provider: {provider}")
    make = {"openai": openai_client, "gemini": gemini_client}[provider](api_key)
    return lambda c: provider_embedding(c, make, provider=provider.title(), **how)


def embed_nodes(nodes: DataFrame, embed: Callable[[Column], Column] = mock_embedding) -> DataFrame:
    """nodes with `embedding` (array<float>); null where the content is blank, as of images."""
    return nodes.withColumn("embedding", F.when(~blank(F.col("content")), embed(F.col("content")).cast("array<float>")))
