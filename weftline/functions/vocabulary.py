"""Names, patterns and word lists of languages and frameworks."""

from __future__ import annotations

from typing import NamedTuple

#: Folders that scans never enter.
SKIPPED_FOLDERS = ("__pycache__", ".venv", "venv", "env", "node_modules", ".git", ".weftline", ".tox", ".mypy_cache", ".pytest_cache")

#: File extensions of each language.
EXTENSIONS = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust", ".java": "java"}

#: Python calls with side effects; an entry that ends in a dot is a prefix, and whole names come first.
PYTHON_EFFECTS = {
    "open": "file_io", "os.": "file_io", "pathlib.": "file_io",
    "requests.": "network", "httpx.": "network", "urllib.": "network", "aiohttp.": "network",
    "redis.": "cache", "memcache.": "cache",
    "subprocess.": "process", "os.system": "process",
}

_SCRIPT_EFFECTS = {
    "fetch": "network", "axios": "network", "http": "network", "https": "network", "XMLHttpRequest": "network", "request": "network",
    "fs.": "file_io", "readFile": "file_io", "writeFile": "file_io",
    "child_process": "process", "exec": "process", "spawn": "process",
    "redis": "cache", "memcached": "cache",
}
#: Calls with side effects in the other languages.
EFFECTS_OF = {
    "javascript": _SCRIPT_EFFECTS,
    "typescript": _SCRIPT_EFFECTS,
    "go": {
        "http.": "network", "net.": "network", "grpc.": "network",
        "os.Open": "file_io", "os.Create": "file_io", "os.ReadFile": "file_io", "ioutil.": "file_io", "bufio.": "file_io",
        "exec.Command": "process", "os.StartProcess": "process", "redis.": "cache", "memcache.": "cache",
    },
    "rust": {
        "reqwest": "network", "hyper": "network", "surf": "network",
        "std::fs": "file_io", "tokio::fs": "file_io", "File::": "file_io",
        "Command::": "process", "std::process": "process", "redis": "cache",
    },
    "java": {
        "HttpClient": "network", "HttpURLConnection": "network", "RestTemplate": "network", "WebClient": "network", "OkHttp": "network",
        "FileInputStream": "file_io", "FileOutputStream": "file_io", "BufferedReader": "file_io", "Files.": "file_io",
        "Runtime.exec": "process", "ProcessBuilder": "process", "Jedis": "cache", "RedisTemplate": "cache",
    },
}

_SCRIPT_TESTS = ("test_", "_test", ".test.", ".spec.", "__tests__")
#: Parts of file names that mark tests.
TEST_NAMES = {"javascript": _SCRIPT_TESTS, "typescript": _SCRIPT_TESTS, "go": ("_test.go",), "rust": (), "java": ("Test", "test_", "_test")}

_SCRIPT_ASSERTS = ("expect", "assert", "should", "toBe", "toEqual", "toHaveBeenCalled", "toThrow", "toContain")
#: Last segments of calls that assert.
ASSERT_CALLS = {
    "javascript": _SCRIPT_ASSERTS,
    "typescript": _SCRIPT_ASSERTS,
    "java": ("assertEquals", "assertTrue", "assertFalse", "assertNotNull", "assertThrows", "assertThat", "verify", "when"),
}
#: Assertion methods in Python tests, beside all that begin with assert_.
PYTHON_ASSERTS = (
    "assertEqual", "assertNotEqual", "assertTrue", "assertFalse", "assertIs", "assertIsNot", "assertIsNone", "assertIsNotNone", "assertIn", "assertNotIn",
    "assertIsInstance", "assertNotIsInstance", "assertRaises", "assertWarns", "assertAlmostEqual", "assertNotAlmostEqual", "assertGreater",
    "assertGreaterEqual", "assertLess", "assertLessEqual", "assertRegex", "assertNotRegex", "assertCountEqual",
)


class Pattern(NamedTuple):
    regex: str
    method: int
    url: int


#: Route definitions by language; group numbers of method (0: any) and URL.
ROUTE_PATTERNS = {
    "python": (
        Pattern(r"""@\w+\.(route|get|post|put|delete|patch)\s*\(\s*["']([^"']+)["']""", 1, 2),
        Pattern(r"""@\w+\.(get|post|put|delete|patch)\s*\(\s*["']([^"']+)["']""", 1, 2),
    ),
    "javascript": (Pattern(r"""\w+\.(get|post|put|delete|patch|all)\s*\(\s*["']([^"']+)["']""", 1, 2),),
    "typescript": (Pattern(r"""\w+\.(get|post|put|delete|patch|all)\s*\(\s*["']([^"']+)["']""", 1, 2),),
    "go": (
        Pattern(r"""HandleFunc\s*\(\s*["']([^"']+)["']""", 0, 1),
        Pattern(r"""\w+\.(GET|POST|PUT|DELETE|PATCH)\s*\(\s*["']([^"']+)["']""", 1, 2),
    ),
    "java": (Pattern(r"""@(Get|Post|Put|Delete|Patch|Request)Mapping\s*\(\s*(?:value\s*=\s*)?["']([^"']+)["']""", 1, 2),),
}
#: Client calls by language.
CLIENT_PATTERNS = {
    "python": (
        Pattern(r"""(?:requests|httpx)\.(get|post|put|delete|patch)\s*\(\s*["']([^"']+)["']""", 1, 2),
        Pattern(r"""(?:requests|httpx)\.(get|post|put|delete|patch)\s*\(\s*f["']([^"']+)["']""", 1, 2),
    ),
    "javascript": (
        Pattern(r"""fetch\s*\(\s*["`']([^"`']+)["`']""", 0, 1),
        Pattern(r"""axios\.(get|post|put|delete|patch)\s*\(\s*["`']([^"`']+)["`']""", 1, 2),
    ),
    "typescript": (
        Pattern(r"""fetch\s*\(\s*["`']([^"`']+)["`']""", 0, 1),
        Pattern(r"""axios\.(get|post|put|delete|patch)\s*\(\s*["`']([^"`']+)["`']""", 1, 2),
    ),
    "go": (Pattern(r"""http\.(Get|Post)\s*\(\s*["']([^"']+)["']""", 1, 2),),
    "java": (
        Pattern(r"""URI\.create\s*\(\s*["']([^"']+)["']""", 0, 1),
        Pattern(r"""(?:restTemplate|RestTemplate)\.\w+\s*\(\s*["']([^"']+)["']""", 0, 1),
    ),
}
#: Names that frameworks have for any method; all others are upper-cased.
METHOD_NAMES = {"route": "ANY", "all": "ANY", "Request": "ANY"}
