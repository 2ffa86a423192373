"""The optional summarising step: a chain of clients, a cache before it, and the layer-2 text where all fail."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersely.functions import fixed
from tersely.operators import cache as caches

#: (name, function of prompt and text); a function raises where it fails.
Client = tuple[str, Callable[[str, str], str]]
OUTPUT_TOKENS, LOCAL_CHARS = 150, 1000


def needed(tokens: Column, enabled: bool = True, threshold: int = fixed.INFERENCE_TOKENS) -> Column:
    return F.lit(enabled) & (tokens > threshold)


def prompt_for(kind: Column, prompts: dict[str, str]) -> Column:
    """The system prompt of a class; generic texts take the log's."""
    own = F.when(kind == "generic", "log").otherwise(kind)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for item in prompts.items() for x in item)), own), F.lit(prompts.get("log", "")))


def remote(url: str, model: str, timeout: float = 30.0) -> Client:
    """A client of a server that streams JSON lines with `response` parts."""

    def ask(prompt: str, text: str) -> str:
        import json
        import urllib.request

        body = json.dumps({"model": model, "system": prompt, "prompt": text, "stream": True}).encode()
        with urllib.request.urlopen(urllib.request.Request(f"{url}/api/generate", body, {"Content-Type": "application/json"}), timeout=timeout) as answer:
            out = "".join(json.loads(line).get("response", "") for line in answer if line.strip()).strip()
        if not out:
            raise ValueError("empty answer")
        return out

    return "remote", ask


def local_server(url: str, timeout: float = 30.0) -> Client:
    """A client of a completion server: the text's first characters, a few tokens, greedily."""

    def ask(prompt: str, text: str) -> str:
        import json
        import urllib.request

        from tersely.operators.kernels import strip_prose

        body = json.dumps({"prompt": f"{prompt}\n\n{text[:LOCAL_CHARS]}", "n_predict": OUTPUT_TOKENS, "temperature": 0}).encode()
        with urllib.request.urlopen(urllib.request.Request(f"{url}/completion", body, {"Content-Type": "application/json"}), timeout=timeout) as answer:
            out = strip_prose(json.loads(answer.read()).get("content", "")).strip()
        if not out:
            raise ValueError("empty answer")
        return out

    return "local", ask


def infer(requests: DataFrame, clients: list[Client]) -> DataFrame:
    """Requests (`hash, prompt, text`) with `summary` and `backend` of the first client that answers, else null and `error`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for prompt, text in zip(batch["prompt"], batch["text"], strict=True):
                row = (None, None, "no client")
                for name, ask in clients:
                    try:
                        row = (ask(prompt, text), name, None)
                        break
                    except Exception as error:  # whatever a client raises, the next one is asked
                        row = (None, None, f"{name}: {error}")
                out.append(row)
            yield batch[["hash"]].assign(**{n: [r[i] for r in out] for i, n in enumerate(("summary", "backend", "error"))})

    return requests.select("hash", "prompt", "text").mapInPandas(run, "hash string, summary string, backend string, error string")


def summarise(requests: DataFrame, cache: DataFrame, clients: list[Client], days: int, now: Column) -> DataFrame:
    """Requests with `output` (cached, new, or their own text) and `backend` ('cache' for hits, null where all clients failed).

    Only distinct misses are sent to the clients."""
    looked = caches.lookup(requests, cache, days, now)
    answers = infer(looked.filter("cached is null").dropDuplicates(["hash"]), clients)
    out = looked.join(answers.select("hash", "summary", F.col("backend").alias("used")), "hash", "left")
    return out.select(*requests.columns, F.coalesce("cached", "summary", "text").alias("output"), F.when(F.col("cached").isNotNull(), "cache").otherwise(F.col("used")).alias("backend"))
