"""Names that are known to do I/O, by language and module.

A line is: languages | modules | kind | names. `*` stands for the module as a whole, `-` for no module. The table of
labels is the product of each line's languages, modules and names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The kinds in the order in which they are listed and sorted.
KINDS = ("filesystem", "network", "service", "process", "database")

# Fixed values.
_PYTHON = """
python | - | filesystem | open input
python | os | filesystem | open read write remove unlink rename replace mkdir makedirs rmdir listdir scandir walk chdir chmod stat lstat symlink truncate getcwd readlink link removedirs
python | os | process | system popen
python | os.path | filesystem | exists lexists isfile isdir getsize getmtime
python | io codecs gzip bz2 lzma tarfile | filesystem | open
python | tempfile | filesystem | TemporaryFile NamedTemporaryFile SpooledTemporaryFile mkstemp mkdtemp *
python | zipfile | filesystem | ZipFile
python | glob | filesystem | glob iglob
python | shutil | filesystem | copy copy2 copyfile move rmtree disk_usage copytree unpack_archive make_archive chown
python | pathlib | filesystem | Path read_text read_bytes write_text write_bytes unlink mkdir open
python | urllib3 ftplib smtplib poplib imaplib socket http.client | network | *
python | urllib.request | network | urlopen urlretrieve
python | requests | network | get post put patch delete head request Session *
python | subprocess | process | run call check_call check_output Popen getoutput getstatusoutput *
python | boto3 botocore google.cloud.storage azure.storage.blob openai litellm ldap ldap3 | service | *
python | sqlite3 | database | connect *
python | psycopg psycopg2 pymysql redis pymongo | database | *
"""

# Fixed values.
_SCRIPT = """
javascript typescript tsx | - | network | fetch XMLHttpRequest
javascript typescript tsx | fs node:fs | filesystem | readFile readFileSync writeFile writeFileSync appendFile appendFileSync mkdir mkdirSync rm rmSync unlink unlinkSync stat statSync readdir readdirSync
javascript typescript tsx | fs node:fs | filesystem | createReadStream createWriteStream existsSync access accessSync copyFile copyFileSync cp cpSync rename renameSync realpath realpathSync lstat lstatSync
javascript typescript tsx | fs node:fs | filesystem | truncate truncateSync open openSync *
javascript typescript tsx | fs/promises node:fs/promises | filesystem | readFile writeFile appendFile mkdir rm unlink stat lstat readdir copyFile rename access open cp *
javascript typescript tsx | net http https dgram node:net node:http node:https | network | *
javascript typescript tsx | child_process node:child_process | process | exec execSync execFile execFileSync spawn spawnSync fork *
"""

# Fixed values.
_COMPILED = """
go | os | filesystem | ReadFile WriteFile Open OpenFile Create Remove RemoveAll Mkdir MkdirAll Rename Stat Chmod ReadDir CreateTemp MkdirTemp Lstat Symlink Truncate Getwd Chdir Readlink *
go | io | filesystem | ReadAll Copy CopyBuffer
go | io/ioutil | filesystem | ReadFile WriteFile ReadDir ReadAll TempDir TempFile
go | path/filepath | filesystem | Walk WalkDir Glob
go | net | network | Dial Listen ListenPacket *
go | net/http | network | Get Post Head NewRequest PostForm ListenAndServe *
go | gocloud.dev/blob/s3blob gocloud.dev/blob/gcsblob gocloud.dev/blob/azureblob | service | *
go | os/exec | process | Command CommandContext *
go | database/sql | database | Open *
rust | std::fs | filesystem | read read_to_string write copy rename remove_file remove_dir remove_dir_all create_dir create_dir_all read_dir metadata canonicalize File OpenOptions *
rust | std::io | filesystem | copy
rust | std::net | network | *
rust | std::process | process | *
c cpp | - | filesystem | fopen fdopen fclose fread fwrite fgets fputs getline open openat read write unlink remove rename stat lstat fstat access chmod mkdir rmdir opendir readdir chdir getcwd
c cpp | stdio.h fcntl.h dirent.h sys/stat.h fstream filesystem | filesystem | *
c cpp | - | network | socket connect send recv sendto recvfrom accept listen bind getaddrinfo
c cpp | sys/socket.h netdb.h arpa/inet.h | network | *
c cpp | - | process | system popen execve execvp fork
c cpp | - | database | sqlite3_open
"""

# Fixed values.
_MANAGED = """
java kotlin | java.io java.io.File java.io.FileInputStream java.io.FileOutputStream java.io.FileReader java.io.FileWriter java.io.RandomAccessFile | filesystem | *
java kotlin | java.nio.file java.nio.file.Files java.nio.file.Path java.nio.file.Paths | filesystem | *
kotlin | kotlin.io | filesystem | *
java kotlin | java.net java.net.Socket java.net.ServerSocket java.net.URL java.net.URI java.net.HttpURLConnection java.net.http java.net.http.HttpClient java.net.http.HttpRequest | network | *
java kotlin | java.sql java.sql.DriverManager java.sql.Connection | database | *
csharp | File Directory FileInfo DirectoryInfo FileStream StreamReader StreamWriter | filesystem | *
csharp | System.IO System.IO.File System.IO.Directory System.IO.FileInfo System.IO.DirectoryInfo System.IO.FileStream System.IO.StreamReader System.IO.StreamWriter | filesystem | *
csharp | HttpClient WebClient Socket TcpClient UdpClient System.Net.Http System.Net.Http.HttpClient System.Net.Sockets System.Net.Sockets.Socket System.Net.WebClient | network | *
csharp | Process System.Diagnostics.Process | process | *
csharp | SqlConnection SqlCommand System.Data.SqlClient Microsoft.Data.SqlClient SqliteConnection | database | *
"""

# Fixed values.
_COMMANDS = """
php | - | filesystem | file_get_contents file_put_contents fopen fclose fread fwrite file file_exists is_file is_dir copy rename scandir opendir readfile unlink mkdir rmdir chmod touch tempnam tmpfile
php | - | network | curl_exec curl_init curl_setopt fsockopen stream_socket_client
php | - | process | exec shell_exec system passthru proc_open
php | - | database | mysqli_connect pg_connect
ruby | - | process | system exec spawn
ruby | - | filesystem | open
ruby | File | filesystem | *
ruby | IO | process | popen
ruby | IO | filesystem | read binread write binwrite foreach
ruby | open-uri net/http socket | network | *
powershell | - | filesystem | Get-Content Set-Content Out-File Add-Content Get-ChildItem New-Item Remove-Item Copy-Item Move-Item Rename-Item Test-Path Clear-Content
powershell | - | network | Invoke-WebRequest Invoke-RestMethod
powershell | - | process | Invoke-Command Start-Process
shell | - | network | curl wget ssh scp nc ncat socat rsync
shell | - | filesystem | rm cp mv mkdir rmdir touch cat chmod chown ln dd tar find ls mktemp gzip gunzip zcat bzip2 xz zip unzip redirect
"""

# PowerShell names that are network whatever the table says, and names that are known not to be I/O.
WINDOWS_NETWORK = "(netadapter|netip|netroute|netfirewall|netconnection|netlbfo|netbios|dnsclient)"
CIM = ("get-ciminstance", "get-cimassociatedinstance", "invoke-cimmethod")
POWERSHELL_NOT_IO = ("write-host", "write-verbose", "write-debug", "invoke-build", "set-buildheader", "write-build")


def rows() -> list[tuple[str, str, str, str]]:
    """(language, module, symbol, kind); an empty symbol is the whole module."""
    out = {}
    for line in "".join((_PYTHON, _SCRIPT, _COMPILED, _MANAGED, _COMMANDS)).strip().splitlines():
        if not line:
            continue
        languages, modules, kind, names = (part.split() for part in line.split("|"))
        for language in languages:
            for module in modules:
                for name in names:
                    out[language, "" if module == "-" else module, "" if name == "*" else name] = kind[0]
    return [(*key, kind) for key, kind in out.items()]


def label_table(spark: SparkSession) -> DataFrame:
    """language, module, symbol, kinds, whole: whether calls into the module count as the module (no single names are listed for it)."""
    listed = {(language, module) for language, module, symbol, _ in rows() if symbol}
    data = [(la, m, s, [k], not s and (la, m) not in listed) for la, m, s, k in rows()]
    return spark.createDataFrame(data, "language string, module string, symbol string, kinds array<string>, whole boolean")
