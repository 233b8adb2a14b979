"""Shell commands and tool names: programs, argument shapes, script references, identities."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OTHER = "(other)"
#: Words before a program, words that are no program, endings that name data.
WRAPPERS = "sudo doas env command exec builtin nohup setsid time nice ionice chrt stdbuf xargs then do else".split()
BRACKETS = "{ } ( )".split()
BUILTINS = "cd pushd popd echo printf export unset set readonly typeset declare local alias source . eval : true false read wait trap umask shift return getopts hash let test [ [[ for while until if elif fi case esac select function done".split()
DATA_ENDINGS = (".output", ".txt", ".log", ".json", ".jsonl", ".md", ".csv", ".tmp", ".out", ".git", ".lock")
SCRIPT_ENDING = r"(?i)\.(sh|bash|zsh|ksh|fish|py|rb|js|mjs|cjs|ts|tsx|pl|php|lua|ps1|bat|cmd|r|jl|groovy|kts)$"
LONGEST = 80

#: Quoted strings, escapes, comments, separators and plain runs of a command line.
PIECE = re.compile(r"(?P<keep>'[^']*'?|\"(?:\\.|[^\"\\])*\"?|\\.|\\)|(?P<cut>(?<!\S)#[^\n]*|&&|\|\||[&|;\n])|(?P<plain>[^'\"\\&|;\n#]+|#)", re.DOTALL)


def statements(command: str) -> list[str]:
    """The command's statements, cut outside quotes and escapes; comments end one."""
    out, begun = [""], False
    for m in PIECE.finditer(command):
        begun = True
        if m.lastgroup == "cut":
            out.append("")
        else:
            out[-1] += m[0]
    return out if begun else []


def _word(token: str) -> str | None:
    """The bare lower-case name a token runs, or None for what stands before a program."""
    if token in WRAPPERS or token in BRACKETS or re.fullmatch(r"[A-Za-z_]\w*(\(\)?)", token, re.ASCII):
        return None
    if re.match(r"[A-Za-z_]\w*=", token, re.ASCII):
        value = token.split("=", 1)[1]
        if value.startswith("$((") or not value.startswith(("$(", "`")):
            return None
        token = value
        if not re.sub(r"^(\$\(|\()?`?", "", token):
            return None
    token = re.sub(r"^(\$\(|\()?`?", "", token)
    return token.rstrip(")\"'`;,").rsplit("/", 1)[-1].lower()


def program(command: str | None) -> str | None:
    """The first real program of a command, else its first builtin, else (other)."""
    if command is None:
        return None
    builtin = None
    for s in statements(command):
        word = next((w for w in map(_word, s.split()) if w is not None), "")
        if word in BUILTINS:
            builtin = builtin or word
        elif re.fullmatch(r"[a-z0-9][a-z0-9._+-]*", word) and not word.isdigit() and word.count(".") < 2 and not word.endswith(DATA_ENDINGS):
            return word if len(word) <= LONGEST else OTHER
    return builtin or OTHER


@F.pandas_udf(T.StringType())
def program_of(command: pd.Series) -> pd.Series:
    return command.map(program)


def argument_shape(args: Column) -> Column:
    """Flags kept, values masked, other words masked, single spaces."""
    tokens = F.filter(F.split(args, r"[ \t\n\r\f]"), lambda t: t != "")
    return F.array_join(F.transform(tokens, lambda t: F.when(~t.startswith("-"), "§").when(F.instr(t, "=") > 0, F.concat(F.substring_index(t, "=", 1), F.lit("=§"))).otherwise(t)), " ")


def script_refs(command: Column) -> Column:
    """Script files a command names, in order: by ending, by ./ or ../, or a first word with a slash."""
    def of_segment(seg: Column) -> Column:
        tokens = F.transform(F.filter(F.split(seg, r"\s+"), lambda t: t != ""), lambda t: F.regexp_replace(t, r"^['\"]+|['\"]+$", ""))
        return F.filter(tokens, lambda t, i: (t != "") & ~t.startswith("-") & ~t.contains("://") & (t.rlike(SCRIPT_ENDING) | t.startswith("./") | t.startswith("../") | ((i == 0) & t.contains("/"))))

    return F.flatten(F.transform(F.split(command, r"\s*(?:&&|\|\||[;|&\n])\s*"), of_segment))


def script_candidates(reference: Column, roots: Column) -> Column:
    """Paths to try for a script: absolute ones first, then longer ones."""
    joined = F.transform(F.filter(roots, lambda r: r != ""), lambda r: F.when(reference.rlike(r"^(/|[A-Za-z]:[\\/])"), reference).otherwise(F.concat(F.regexp_replace(r, "/+$", ""), F.lit("/"), F.regexp_replace(reference, r"^\./", ""))))
    paths = F.array_distinct(F.concat(joined, F.array(reference)))
    absolute = lambda p: F.when(p.rlike(r"^(/|[A-Za-z]:[\\/])"), 0).otherwise(1)
    keyed = F.transform(paths, lambda p, i: F.struct(absolute(p).alias("a"), (-F.length(p)).alias("n"), i.alias("i"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda x: x["p"])


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t) if t is not None else None)


def tool_name(raw: Column) -> Column:
    """Trimmed name with UUIDs and hexadecimal tails of eight or more as <dyn>, 120 characters."""
    x = F.regexp_replace(F.trim(raw), r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<dyn>")
    return F.left(F.regexp_replace(x, r"(?<![0-9a-fA-F])[0-9a-fA-F]{8,}(?![0-9A-Za-z])", "<dyn>"), F.lit(120))


def split_tool_name(observed: Column) -> dict[str, Column]:
    """server and name: mcp__s__t, mcp.s.t and mcp:s:t have the server mcp:s; anything else is builtin."""
    t = F.trim(observed)
    server, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for sep in ("__", r"\.", ":"):
        pattern = rf"^mcp{sep}(?!{sep})(.+?){sep}(.+)$"
        hit = t.rlike(pattern) & server.isNull()
        server, name = F.when(hit, F.regexp_extract(t, pattern, 1)).otherwise(server), F.when(hit, F.regexp_extract(t, pattern, 2)).otherwise(name)
    return {"server": F.when(server.isNotNull(), F.concat(F.lit("mcp:"), F.left(tool_name(server), F.lit(116)))).otherwise("builtin"), "name": tool_name(F.coalesce(name, observed))}


def tool_identity(server: Column, name: Column) -> Column:
    return F.when(server == "builtin", name).otherwise(F.concat(server, F.lit("/"), name))


def tool_action(observed: Column, command: Column, redacted: Column, most: int = 4096) -> Column:
    """surface, program, shape and clamped input of a call; the program needs the Arrow UDF, so it is given
    by :func:`program_of` over ``command``."""
    from .redact import clamp_bytes

    server = split_tool_name(observed)["server"]
    surface = F.when(server != "builtin", "mcp").when(command.isNotNull(), "shell").otherwise("builtin")
    return F.struct(surface.alias("surface"), F.when(surface == "shell", program_of(command)).alias("executable"), F.when(surface == "shell", argument_shape(F.regexp_replace(command, r"^\s*\S+", ""))).alias("shape"), clamp_bytes(redacted, most).alias("input"), (F.octet_length(redacted) > most).alias("input_truncated"))
