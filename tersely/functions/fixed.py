"""Patterns, word lists and markers that results depend on. They are data, in natural order."""

#: Line templates: ordered (pattern, replacement); `$1` is the first group.
TEMPLATE_STEPS = (
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<TS>"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
    (r"\b[0-9a-fA-F]{8,}\b", "<HEX>"),
    (r"<HEX>-[a-z0-9]{5}\b", "<HEX>-<POD>"),
    (r"((?:^|[\s+(\[]))(@?[a-zA-Z][\w@/.-]*?)\s+v?\d+\.\d+\.\d+(?:\.\d+)?(?:-[\w.]+)?", "$1<PKG> <VER>"),
    (r"\bv?\d+\.\d+\.\d+(?:\.\d+)?(?:-[\w.]+)?\b", "<VER>"),
    (r"(^|[^\w.])(\d+)", "$1<N>"),
    (r"^(> Task :)\S+(?: [A-Z][A-Z\-]+)?$", "$1<TASK>"),
)

#: Opaque tokens: ordered (pattern, replacement).
OPAQUE_STEPS = (
    (r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "<JWT>"),
    (r"\b([0-9a-fA-F]{8})[0-9a-fA-F]{24,}\b", "$1..."),
    (r"\?[A-Za-z0-9=&_%+.-]{20,}", "?<QUERY>"),
    (r"[A-Za-z0-9+/]{40,}={0,2}", "<B64>"),
)

PROGRESS = ("[====", "[####", "[----", "⠋", "⠙", "⠹", "⠸", "⠼", "⠴", "⠦", "⠧", "⠇", "⠏", "Downloading")
CARGO_VERBS = ("Compiling ", "Checking ", "Building ", "Fresh ", "Installing ", "Updating ")

ERROR_SIGNAL = (
    r"(?m)([A-Z][A-Za-z0-9_]*(?:Error|Exception):(?:\s|$)|(?:^|\s)(?:Error|Exception):(?:\s|$)|\b(?:ERROR|FAILED|CRITICAL|PANIC)\b"
    r"|(?:^|\s)(?:error|panic|fatal|warning):\s|\bTraceback\b|\bE0\d{3}:|\bCaused by:)"
)

#: Framework frames by family: (any of these starts, any of these parts); an empty tuple asks for nothing. The left-trimmed line counts.
FRAME_FAMILIES = (
    ("jvm", ("at org.springframework.", "at org.apache.catalina.", "at org.apache.tomcat.", "at org.apache.coyote.", "at javax.servlet.", "at jakarta.servlet.", "at jdk.internal.reflect.", "at java.lang.reflect."), ()),
    ("jvm proxies", (), ("$$FastClassBySpringCGLIB$$", "$$EnhancerBySpringCGLIB$$", "CglibAopProxy", "ReflectiveMethodInvocation")),
    ("python", ('File "',), ("/django/", "/site-packages/", "\\site-packages\\", "/gunicorn/", "/werkzeug/", "/wsgiref/", "/asgiref/")),
    ("ruby callers", ("from ",), ("actionpack", "activesupport", "activerecord", "actionview", "railties", "/rack/")),
    ("node", ("at ",), ("node:internal/", "node_modules/express/", "node_modules\\express\\", "Layer.handle ", "next (", "Function.handle ", "Function.dispatch ")),
    ("go", ("runtime.",), ()),
    ("go sources", ("/",), ("/go/src/runtime/", "\\go\\src\\runtime\\")),
    ("php", ("#",), ("/vendor/symfony/", "/vendor/laravel/", "/vendor/illuminate/", "\\vendor\\symfony\\", "\\vendor\\laravel\\")),
    ("php classes", ("at Symfony\\", "at Illuminate\\", "at Laravel\\"), ()),
    ("php files", ("(",), ("/vendor/symfony/", "/vendor/laravel/", "/vendor/illuminate/")),
    ("rust", (), ("core::panicking::", "std::panicking::", "rust_panic", "rust_begin_unwind")),
    ("dotnet", ("at Microsoft.AspNetCore.", "at Microsoft.Extensions.", "at System.Threading.Tasks.", "at System.Runtime.ExceptionServices.", "at System.Runtime.CompilerServices.", "at Microsoft.EntityFrameworkCore."), ()),
    ("browser", ("at ",), ("webpack://", "webpack-internal:", "node_modules/react-dom/", "node_modules\\react-dom\\", "node_modules/react/", "node_modules\\react\\", "node_modules/next/", "node_modules\\next\\", "__zone_symbol__", "zone.js")),
    ("react native", ("at ",), ("node_modules/react-native/", "node_modules\\react-native\\", "node_modules/metro-", "node_modules\\metro-", "ReactNativeRenderer")),
    ("android", ("at androidx.", "at com.android.", "at kotlinx.coroutines.", "at kotlin.coroutines.", "at dalvik.system."), ()),
)
RUBY_PARTS = FRAME_FAMILIES[3][2]
#: Frames of the user; only the families up to Node's may still claim such a line.
USER_FRAMES = ("main.main(",)
BEFORE_USER_FRAMES = FRAME_FAMILIES[:5]

RUN_MARK, OMITTED = "[×", "framework frames omitted"
PREFIX_HEADER, PREFIX_ROW, SUFFIX_HEADER, SUFFIX_ROW, BLOCK_HEADER = "── common prefix:", "↳ ", "── common suffix:", "↰ ", "── ×"
MARKER_STARTS, MARKER_PART = (PREFIX_HEADER, PREFIX_ROW, SUFFIX_HEADER, SUFFIX_ROW, BLOCK_HEADER, RUN_MARK), "frames omitted]"

CLUSTER_LINES, CLUSTER_BYTES, CLUSTERS, CLUSTER_OVERHEAD = 5, 12, 8, 22
BLOCK_SIZES, BLOCK_RUN = (2, 50), 3
FRAME_RUN = 3

LEVELS = ("[INFO]", "[ERROR]", "[WARN]", "[DEBUG]", "INFO ", "ERROR ", "WARN ", "DEBUG ")
EXCLUDED_COMMANDS = ("cat", "echo", "pwd")
MAX_INPUT_BYTES, HARD_CAP_BYTES, INFERENCE_TOKENS = 100_000, 10_000_000, 300

INTENT_TAGS = ("command-name", "command-message", "command-args", "local-command-stdout", "local-command-stderr")
INTENT_CHARS, INTENT_BUDGETS, INTENT_LEAST = 500, (0.60, 0.25, 0.10, 0.03, 0.02), 20

#: What stands before and behind an intent in a prompt, by form.
CONTEXT_FORMS = {
    "prefix": ('CONTEXT: The user\'s most recent request was: "', '". Summarize the tool output focusing on information relevant to that request.\n\n'),
    "xml": ("<user_intent>", "</user_intent>\n\n"),
    "goal": ("User goal: ", " — extract only information that advances this goal.\n\n"),
    "json": ('{"user_intent": "', '"}\n\n'),
}

PROSE_STARTS = ("note:", "note ", "please", "if the", "if you", "assumption:", "replace ", "the above", "i have", "the duration", "actual duration")
PROSE_PARTS = ("not provided", "not available", "not specified", "not present", "not found", "not given", "not applicable", "n/a", "unknown")
