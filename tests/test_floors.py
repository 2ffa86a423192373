"""Least reductions by shape of output: made-up texts of each shape, through the whole pipeline with the rule files."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import tersely
from tersely.operators.rules import load_folder
from tersely.plans.compaction import compact

WORDS = "alpha bravo cedar delta ember fjord gamma haven indigo juniper kayak lemon".split()


def word(i: int) -> str:
    return WORDS[i % len(WORDS)]


def rows(n: int, line) -> str:
    return "\n".join(line(i) for i in range(n))


def trace(head: str, user: str, frame, n: int) -> str:
    return f"{head}\n{user}\n{rows(n, frame)}\n{user}"


#: Shape: (text, least reduction).
SHAPES = {
    "repetitive container log": (rows(170, lambda i: f"2024-05-01T10:{i // 60:02}:{i % 60:02}Z INFO health check passed in {i % 9 + 1} ms"), 0.5),
    "compose logs": (rows(100, lambda i: f"{('web', 'db', 'cache')[i // 34]}-1  | 2024-05-01 10:00:{i % 60:02} request {i} served in {i % 7}ms"), 0.25),
    "gradle build": (rows(120, lambda i: f"> Task :{word(i)}:compile{word(i + 3).title()} UP-TO-DATE") + "\nBUILD SUCCESSFUL in 12s", 0.85),
    "package install": (rows(50, lambda i: f"+ {word(i)}-{word(i + 5)} {i % 9}.{i % 5}.{i % 3}") + "\nDone in 3.1s", 0.73),
    "passing tests": ("running 60 tests\n" + rows(60, lambda i: f"test {word(i)}::{word(i + 1)}_{i} ... ok") + "\ntest b::c ... FAILED\ntest result: FAILED. 60 passed; 1 failed", 0.55),
    "spring trace": (trace("java.lang.IllegalStateException: no row", "\tat com.shop.Cart.add(Cart.java:12)", lambda i: f"\tat org.springframework.web.{word(i).title()}.invoke({word(i).title()}.java:{i + 40})", 36), 0.4),
    "django trace": ("Traceback (most recent call last):\n" + rows(12, lambda i: f'  File "/venv/lib/site-packages/django/{word(i)}.py", line {i + 9}, in {word(i + 2)}\n    return self.{word(i + 4)}(request)') + '\n  File "/app/views.py", line 3, in show\n    row = find(key)\nValueError: no such key', 0.55),
    "express trace": (trace("TypeError: x is not a function", "    at show (/app/routes.js:3:9)", lambda i: f"    at {word(i)} (/app/node_modules/express/lib/router/{word(i)}.js:{i + 90}:12)", 22), 0.5),
    "go panic": ("panic: index out of range\n\ngoroutine 1 [running]:\n" + rows(12, lambda i: f"runtime.{word(i)}(0x1400{i})\n\t/usr/local/go/src/runtime/{word(i)}.go:{i + 100} +0x1c") + "\nmain.main()\n\t/app/main.go:7 +0x20", 0.4),
    "aspnet trace": (trace("System.InvalidOperationException: empty", "   at Shop.Cart.Add() in /src/Cart.cs:line 9", lambda i: f"   at Microsoft.AspNetCore.Mvc.{word(i).title()}.Invoke{i}(HttpContext context)", 18), 0.35),
    "symfony trace": (trace("PHP Fatal error: uncaught exception", "#0 /app/src/Cart.php(9): add()", lambda i: f"#{i + 1} /app/vendor/symfony/http-kernel/{word(i).title()}.php({i + 30}): handle()", 24), 0.6),
    "react trace": (trace("Error: render failed", "    at Cart (/app/src/Cart.tsx:9:3)", lambda i: f"    at {word(i)} (webpack://app/./node_modules/react-dom/{word(i)}.js:{i + 500}:22)", 20), 0.45),
    "android trace": (trace("java.lang.NullPointerException: view", "\tat com.shop.CartActivity.show(CartActivity.kt:9)", lambda i: f"\tat androidx.fragment.app.{word(i).title()}.perform({word(i).title()}.java:{i + 80})", 24), 0.35),
    "rails trace": (trace("NoMethodError (undefined method `x' for nil):", "app/models/cart.rb:9:in `add'", lambda i: f"actionpack (7.0.4) lib/action_controller/{word(i)}.rb:{i + 20}:in `process'", 28), 0.05),
    "terraform plan": (rows(12, lambda i: f'  # aws_instance.app[{i}] will be created\n  + resource "aws_instance" "app" {{\n' + rows(22, lambda k: f"      + {word(k)}_{word(k + 5):<20} = {('(known after apply)', 'true', str(k * 8))[k % 3]}") + "\n    }\n") + "\nPlan: 12 to add", 0.83),
    "typecheck": (rows(48, lambda i: f"node_modules/@types/{word(i)}/index.d.ts({i + 3},{i % 9}): error TS2300: Duplicate identifier '{word(i + 2)}'."), 0.1),
    "maven tests": ("[INFO] Scanning for projects...\n" + rows(12, lambda i: rows(5, lambda k: f"[INFO] --- {word(k)}-plugin:3.{k}.1:{word(k)} (default-{word(k)}) @ {word(i)} ---\n[INFO] Nothing to do for {word(k)}") + "\n" + rows(12, lambda k: f"[INFO] Tests run: {k + 1}, Failures: 0, Errors: 0, Time elapsed: 0.{k:03} s")) + "\n[INFO] BUILD SUCCESS", 0.5),
    "git diff": (rows(12, lambda i: f"diff --git a/src/{word(i)}.py b/src/{word(i)}.py\nindex 12ab34{i:02}..99cd00{i:02} 100644\n--- a/src/{word(i)}.py\n+++ b/src/{word(i)}.py\n@@ -1,4 +1,4 @@\n-old {word(i)} line\n+new {word(i + 3)} line"), 0.05),
    "pytest": (rows(250, lambda i: f"tests/test_{word(i)}.py::test_{word(i + 1)}_{word(i + 4)} PASSED   [ {i // 3}%]"), 0.18),
    "bazel build": (rows(66, lambda i: f"INFO: From Compiling src/{word(i)}/{word(i + 2)}.cc: [{i} / 66] took {i % 5}.{i % 9}s") + "\nINFO: Build completed successfully", 0.29),
    "short": ("error: no such file", 0.0),
}


@pytest.fixture(scope="module")
def reduced(spark):
    files = load_folder(str(Path(tersely.__file__).parent / "rulesets"))
    requests = spark.createDataFrame([(name, text) for name, (text, _) in SHAPES.items()], "name string, output string")
    return {r.name: r for r in compact(requests.withColumn("command", F.lit(None).cast("string")), files).collect()}


@pytest.mark.parametrize("name", SHAPES)
def test_floors(reduced, name):
    got = reduced[name]
    assert got.ratio >= SHAPES[name][1], (name, got.ratio, got.applied_rules, got.compressed[:400])
    assert got.tokens_after <= 10 * got.tokens_before + 50


def test_errors_and_own_frames_stay(reduced):
    for name, part in {"spring trace": "com.shop.Cart.add", "django trace": "/views.py", "express trace": "routes.js", "go panic": "main.main()", "passing tests": "b::c ... FAILED", "symfony trace": "Cart.php", "short": "error: no such file"}.items():
        assert part in reduced[name].compressed
