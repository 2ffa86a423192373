"""Made-up command outputs by a seeded grammar: every shape of the baseline, as many variants as wanted, built by Spark.

A shape has lines before, lines that repeat, and lines after. Slots in a line are filled by hashes of seed, variant, line and slot:
{w}, {x}, {y} words, {W} a capitalised one, {m} a word that is the same for one round of the repeated lines, {n} a number, {d} a
digit, {h} a hexadecimal run, {t} the time, {i} the line's number.
The texts are our own; least reductions and layers are the baseline's."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tersely.functions.lines import assemble

WORDS = tuple("alpha bravo cedar delta ember fjord gamma haven indigo juniper kayak lemon mango nectar olive pepper quartz raven saffron tulip umber violet willow yarrow zephyr".split())


class Shape(NamedTuple):
    stem: str
    category: str
    min_ratio: float
    expected_layer: int
    head: tuple[str, ...]
    body: tuple[str, ...]
    times: int
    tail: tuple[str, ...] = ()


def frames(stem: str, floor: float, error: str, own: str, body: tuple[str, ...], times: int, layer: int = 2) -> Shape:
    """A stack trace: the error, a frame of the user, frames of a framework, a frame of the user."""
    return Shape(stem, "stack_trace", floor, layer, (error, own), body, times, (own,))


SHAPES = (
    Shape("already_short", "short", 0.0, 0, ("error: no such file: {w}",), (), 0),
    Shape("bazel_build_verbose", "build", 0.29, 2, ("INFO: Analyzed target //{w}:all.",), ("INFO: From Compiling src/{w}/{x}.cc: [{i} / 70] took {d}.{d} s",), 66, ("INFO: Build completed successfully, 70 total actions",)),
    Shape("cargo_build_verbose", "build", 0.02, 2, ("    Updating crates.io index",), ("   Compiling {w}-{x} v{d}.{d}.{d}",), 68, ("warning: unused import: `{w}::{x}`", "    Finished dev profile in {n}.{d}s")),
    Shape("cargo_test_failures", "test", 0.3, 2, ("running 58 tests",), ("test {w}::{x}_{i} ... ok",), 54, ("test {w}::{x} ... FAILED", "thread '{w}' panicked at src/{x}.rs:{n}:5", "assertion failed: left == right", "test result: FAILED. 54 passed; 1 failed")),
    frames("csharp_aspnet_trace", 0.35, "System.InvalidOperationException: sequence is empty", "   at Shop.Cart.Add() in /src/Cart.cs:line 9", ("   at Microsoft.AspNetCore.Mvc.{W}.Invoke{n}(HttpContext context)",), 18),
    Shape("docker_compose_logs", "container_log", 0.25, 2, (), ("web-1    | 2024-05-01T10:{t}Z INFO request {n} served in {d} ms",) * 3 + ("db-1     | 2024-05-01T10:{t}Z LOG checkpoint {n} complete",) * 2, 20, ("web-1    | 2024-05-01T10:59:59Z ERROR upstream {w} refused",)),
    Shape("docker_logs_repetitive", "logs", 0.5, 2, (), ("2024-05-01T10:{t}Z INFO health check passed in {d} ms",), 170, ("2024-05-01T10:59:59Z ERROR: connection to {w} lost",)),
    Shape("dotnet_build_warnings", "build", 0.56, 2, ("Build started.",), ("/src/Shop/Models/Cart.cs({n},{n}): warning CS8618: Non-nullable property must contain a non-null value when exiting constructor. [/src/Shop/Shop.csproj]",), 32, ("    32 Warning(s)", "    0 Error(s)")),
    frames("elixir_phoenix_trace", 0.05, "** (RuntimeError) no {w}", "    (shop 0.1.0) lib/shop/cart.ex:9: Shop.Cart.add/2", ("    (phoenix 1.7.{d}) lib/phoenix/{w}.ex:{n}: Phoenix.{W}.call/2", "    (plug 1.15.{d}) lib/plug/{w}.ex:{n}: Plug.{W}.call/2"), 8),
    Shape("eslint_stylish", "build", 0.0, 2, (), ("/src/{w}/{x}.ts", "  {n}:{d}  error  '{y}' is defined but never used  no-unused-vars", ""), 10, ("✖ 10 problems (10 errors, 0 warnings)",)),
    frames("fastapi_starlette_trace", 0.68, "Traceback (most recent call last):", '  File "/app/main.py", line 9, in show', ('  File "/venv/lib/site-packages/starlette/{w}.py", line {n}, in __call__', "    await self.app(scope, receive, send)"), 18),
    Shape("generic_long_log", "logs_unstructured", 0.5, 3, (), ("{w} {x} {y} went on for {n} turns while {x} kept {w} waiting near the {y} of {W}, and nobody at {x} asked why {y} had left",), 40),
    Shape("git_diff_large", "diff", 0.05, 2, (), ("diff --git a/src/{w}.py b/src/{w}.py", "index 12ab34c..99cd00e 100644", "--- a/src/{w}.py", "+++ b/src/{w}.py", "@@ -{n},4 +{n},4 @@", " def {x}():", "-    return {y}", "+    return {y} + {n}"), 18),
    frames("go_panic_trace", 0.4, "panic: runtime error: index out of range [{d}]", "main.main()", ("runtime.{w}(0x1400{n})", "\t/usr/local/go/src/runtime/{w}.go:{n} +0x1c"), 13),
    Shape("go_test_verbose", "test", 0.11, 2, (), ("=== RUN   Test{W}{i}", "--- PASS: Test{W}{i} (0.0{d}s)"), 27, ("--- FAIL: Test{W} (0.01s)", "FAIL")),
    Shape("gradle_build_verbose", "build", 0.85, 2, (), ("> Task :{w}:compile{W} UP-TO-DATE",), 124, ("BUILD SUCCESSFUL in 12s",)),
    frames("kotlin_android_trace", 0.35, "java.lang.NullPointerException: {w}", "\tat com.shop.CartActivity.show(CartActivity.kt:9)", ("\tat androidx.fragment.app.{W}.perform({W}.java:{n})",), 24),
    Shape("kubectl_describe_pod", "container_log", 0.0, 2, ("Name:         {w}-7d9f", "Namespace:    default"), ("  {W}:    {x}-{n}",), 30, ("Events:  <none>",)),
    Shape("kubectl_get_events", "container_log", 0.01, 2, ("LAST SEEN   TYPE      REASON      OBJECT      MESSAGE",), ("{d}m{n}s      Normal    Pulled      pod/{w}-{h}      Container image \"{x}:{d}.{d}.{d}\" already present on machine",), 38),
    Shape("maven_build_tests", "build", 0.5, 2, ("[INFO] Scanning for projects...", *("[INFO]   {w}-{x} [jar]",) * 13), (
        "[INFO] ----------------------< com.shop:{m} >----------------------", "[INFO] Building {m} 1.4.2", "[INFO] ------------------------------[ jar ]-------------------------------", "[INFO]",
        "[INFO] --- resources-plugin:3.3.1:resources (default-resources) @ {m} ---", "[INFO] Copying filtered resources with UTF-8.", "[INFO] --- compiler-plugin:3.11.0:compile (default-compile) @ {m} ---", "[INFO] Compiling {n} source files to target/classes",
        "[INFO] --- surefire-plugin:3.2.5:test (default-test) @ {m} ---", "[INFO]", "[INFO] -------------------------------------------------------", "[INFO]  T E S T S", "[INFO] -------------------------------------------------------",
        "[INFO] Running com.shop.{W}Test", "[INFO] Tests run: {d}, Failures: 0, Errors: 0, Skipped: 0, Time elapsed: 0.{n} s", "[INFO] Results:", "[INFO] Tests run: {d}, Failures: 0, Errors: 0, Skipped: 0", "[INFO]",
    ), 15, ("[INFO] BUILD SUCCESS",)),
    Shape("nextjs_build_routes", "build", 0.04, 2, ("   Creating an optimized production build ...", "Route (app)                              Size     First Load JS"), ("├ ○ /{w}/{x}                          {n} B          {n} kB",), 36, ("○  (Static)  prerendered as static content",)),
    frames("node_express_trace", 0.5, "TypeError: {w} is not a function", "    at show (/app/routes.js:3:9)", ("    at {w} (/app/node_modules/express/lib/router/{x}.js:{n}:12)",), 22),
    frames("php_symfony_trace", 0.6, "PHP Fatal error: Uncaught RuntimeException: {w}", "#0 /app/src/Cart.php(9): add()", ("#{i} /app/vendor/symfony/http-kernel/{W}.php({n}): handle()",), 24),
    Shape("pnpm_install_large", "build", 0.73, 2, ("Packages: +48",), ("+ {w}-{x} {d}.{d}.{d}",), 48, ("Done in 3.{d}s",)),
    Shape("pytest_verbose_large", "test", 0.18, 2, ("============================= test session starts ==============================",), ("tests/test_{w}.py::test_{x}_{y} PASSED                       [ {d}%]",), 274, ("FAILED tests/test_{w}.py::test_{x} - AssertionError: {y}",)),
    frames("python_django_trace", 0.55, "Traceback (most recent call last):", '  File "/app/shop/views.py", line 9, in show', ('  File "/venv/lib/site-packages/django/core/{w}.py", line {n}, in inner', "    response = get_response(request)"), 10),
    Shape("rspec_documentation", "test", 0.0, 2, (), ("{W}", "  adds {x}", "  removes {y}"), 13, ("26 examples, 0 failures",)),
    frames("ruby_rails_trace", 0.05, "NoMethodError (undefined method `{w}' for nil):", "app/models/cart.rb:9:in `add'", ("actionpack (7.0.4) lib/action_controller/{w}.rb:{n}:in `process'",), 28),
    frames("stack_trace_java", 0.4, "java.lang.IllegalStateException: no {w}", "\tat com.shop.Cart.add(Cart.java:12)", ("\tat org.springframework.web.{W}.invoke({W}.java:{n})",), 38, 3),
    frames("swift_uikit_crash", 0.0, "Fatal error: Unexpectedly found nil", "0   Shop    0x{h} CartView.show() + {n}", ("{d}   UIKitCore    0x{h} -[UI{W} {x}] + {n}",), 15),
    Shape("terraform_plan_apply", "build", 0.83, 2, ("Terraform will perform the following actions:", ""), (
        "  # aws_instance.app[{d}] will be created", '  + resource "aws_instance" "app" {', *(f"      + {WORDS[k]}_{WORDS[k + 3]} = (known after apply)" for k in range(18)), "      + tags = {", '          + "Role" = "application"', "        }", "    }", "",
    ), 12, ("Plan: 12 to add, 0 to change, 0 to destroy.",)),
    Shape("tsc_errors_node_modules", "typecheck", 0.1, 2, (), ("node_modules/@types/{w}/index.d.ts({n},{d}): error TS2300: Duplicate identifier '{x}'.",), 50),
    frames("typescript_react_trace", 0.45, "Error: render of {w} failed", "    at Cart (/app/src/Cart.tsx:9:3)", ("    at {w} (webpack://app/./node_modules/react-dom/{x}.js:{n}:22)",), 20),
    Shape("webpack_stats", "build", 0.28, 2, (
        *("asset {w}.bundle.js {n} KiB [emitted] (name: {x})",) * 6, "runtime modules 4.9 KiB 11 modules", "modules by path ./node_modules/ 1.4 MiB 327 modules", *("  modules by path ./node_modules/{w}-{x}/ {n} KiB {d} modules",) * 8, "modules by path ./src/ 142 KiB",
    ), ("  ./src/{w}/{x}.tsx 4.2 KiB [built] [code generated]",), 20, ("webpack compiled successfully in {n} ms", "WARNING in asset size limit: an asset is over the recommended size")),
    Shape("payload_cargo", "test", 0.55, 2, ("running 60 tests",), ("test {w}::{x}_{i} ... ok",), 60, ("test result: FAILED. 60 passed; 1 failed",)),
    Shape("payload_tsc", "typecheck", 0.05, 2, (), ("node_modules/@types/{w}/index.d.ts({n},{d}): error TS2322: Type '{x}' is not assignable to type '{y}'.",), 12),
    Shape("payload_docker", "container_log", 0.3, 2, (), ("2024-05-01T10:{t}Z INFO worker {d} ready",), 20),
    Shape("payload_git_diff", "diff", 0.05, 2, (), ("diff --git a/{w}.py b/{w}.py", "index 12ab34c..99cd00e 100644", "--- a/{w}.py", "+++ b/{w}.py", "@@ -1,2 +1,2 @@", "-{x}", "+{y}"), 3),
)


def filled(line: Column, section: Column, *place: Column) -> Column:
    """The line with its slots filled; equal slots of a line get equal values, {m} the same in its section."""

    def pick(slot: str, n: int) -> Column:
        return F.pmod(F.xxhash64(*place, F.lit(slot)), F.lit(n)).cast("int")

    words = F.array(*map(F.lit, WORDS))
    minute, second = (F.lpad(F.pmod(x, F.lit(60)).cast("string"), 2, "0") for x in (F.floor(place[-1] / 60), place[-1]))
    values = {
        "m": words[F.pmod(F.xxhash64(*place[:-1], section, F.lit("m")), F.lit(len(WORDS))).cast("int")], **{s: words[pick(s, len(WORDS))] for s in ("w", "x", "y")}, "W": F.initcap(words[pick("W", len(WORDS))]), "n": pick("n", 900).cast("string"), "d": pick("d", 9).cast("string"),
        "h": F.lower(F.lpad(F.hex(pick("h", 1 << 31)), 12, "a")), "t": F.concat(minute, F.lit(":"), second), "i": place[-1].cast("string"),
    }
    for slot, value in values.items():
        line = F.replace(line, F.lit("{" + slot + "}"), value)
    return line


def grammar(spark: SparkSession, variants: int = 1, seed: int = 1) -> DataFrame:
    """`stem, variant, text`: so many variants of each shape, the same for a seed."""
    numbered = lambda s: [*((0, x) for x in s.head), *((r + 1, x) for r in range(s.times) for x in s.body), *((0, x) for x in s.tail)]
    shapes = spark.createDataFrame([(s.stem, numbered(s)) for s in SHAPES], "stem string, lines array<struct<section:int,line:string>>")
    rows = spark.range(variants).withColumnRenamed("id", "variant").crossJoin(F.broadcast(shapes)).select("stem", "variant", F.posexplode("lines").alias("n", "at"))
    lines = rows.select(F.struct("stem", "variant").alias("doc_id"), "n", filled(F.col("at.line"), F.col("at.section"), F.lit(seed), F.col("variant"), F.xxhash64("stem"), F.col("n")).alias("line"))
    return assemble(lines).select("doc_id.*", "text")


def shape_meta(spark: SparkSession) -> DataFrame:
    """`stem, category, min_ratio, expected_layer` of every shape."""
    return spark.createDataFrame([(s.stem, s.category, s.min_ratio, s.expected_layer) for s in SHAPES], "stem string, category string, min_ratio double, expected_layer int")
