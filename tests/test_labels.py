import pytest

from quarry.functions.label_table import label_table, rows
from quarry.operators.labels import known, label, probes


def test_table_size(spark):
    per = {}
    for language, *_ in rows():
        per[language] = per.get(language, 0) + 1
    # How many names each language has.
    assert per == {"python": 107, "javascript": 127, "typescript": 127, "tsx": 127, "go": 53, "rust": 19, "java": 23, "kotlin": 24, "csharp": 32, "c": 51, "cpp": 51, "php": 34, "ruby": 14, "powershell": 16, "shell": 31}
    assert label_table(spark).where("whole").count() == 147


CASES = [
    ("python", "os", "remove", ["filesystem"]), ("python", "os.path", "join", None), ("python", "os", "path.exists", ["filesystem"]), ("python", "requests", "get", ["network"]), ("python", "boto3", "client", ["service"]),
    ("python", "pathlib", "Path.read_text", ["filesystem"]), ("rust", "std::net::TcpStream", "connect", ["network"]), ("rust", "std::net", "TcpStream", None), ("rust", "std::process", "exit", None), ("rust", "std::fs::File", "open", ["filesystem"]),
    ("powershell", "", "get-content", ["filesystem"]), ("powershell", "", "Get-NetAdapter", ["network"]), ("powershell", "", "Write-Host", []), ("java", "java.nio.file.Files", "readString", ["filesystem"]), ("shell", "", "redirect", ["filesystem"]),
    ("go", "net/http", "Client.Do", None), ("csharp", "System.IO", "File.ReadAllText", ["filesystem"]), ("python", "", "print", None),
]


def test_first_match(spark):
    symbols = spark.createDataFrame([c[:3] for c in CASES], "language string, module string, symbol string")
    got = {(r.language, r.module, r.symbol): r.kinds for r in label(symbols).collect()}
    assert got == {c[:3]: c[3] for c in CASES}
    assert known(label(symbols)).where("io is null or kinds is null").count() == 0


@pytest.mark.parametrize("module, symbol", [("", ""), ("a::b::c", "d.e"), ("m", "a.b.c"), ("", "x")])
def test_probes_end(module, symbol):
    assert probes(module, symbol)
