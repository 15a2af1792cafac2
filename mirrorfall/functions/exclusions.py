"""Exclusion packs and policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .globs import glob_regex, matches_any
from .paths import extension

#: The eight packs, their extensions and path patterns.
PACKS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "system-libraries": (("dll", "so", "dylib", "pyd", "class", "jar", "pak", "asar", "mui", "ocx", "drv", "sys", "lib", "a", "node"), ()),
    "build-artefacts": ((), ("**/node_modules/**", "**/__pycache__/**", "**/.venv/**", "**/venv/**", "**/.virtualenv/**", "**/target/**", "**/build/**", "**/dist/**", "**/out/**", "**/.next/**", "**/.nuxt/**", "**/.svelte-kit/**", "**/.angular/cache/**", "**/.gradle/**", "**/.idea/build/**", "**/cmake-build-*/**")),
    "vcs-internals": ((), ("**/.git/objects/**", "**/.git/lfs/**", "**/.git/refs/**", "**/.git/pack/**", "**/.svn/**", "**/.hg/**", "**/.bzr/**", "**/CVS/**")),
    "package-manager-caches": ((), ("**/.m2/repository/**", "**/.gradle/caches/**", "**/.cargo/registry/**", "**/.cargo/git/**", "**/.npm/_cacache/**", "**/.npm/_logs/**", "**/.yarn/cache/**", "**/.pnpm-store/**", "**/.bundle/cache/**", "**/.composer/cache/**", "**/.cache/pip/**", "**/.cache/uv/**", "**/Library/Caches/Homebrew/**")),
    "os-system-trees": ((), ("C:/Windows/WinSxS/**", "C:/Windows/System32/**", "C:/Windows/SysWOW64/**", "C:/Windows/Installer/**", "C:/Windows/servicing/**", "**/AppData/Local/Microsoft/Windows/Caches/**", "**/AppData/Local/Microsoft/Edge/User Data/Default/Cache/**", "/usr/lib/**", "/usr/lib32/**", "/usr/lib64/**", "/usr/share/locale/**", "/var/lib/dpkg/info/**", "**/.local/share/Trash/**")),
    "browser-caches": ((), ("**/Cache_Data/**", "**/cache2/**", "**/Service Worker/**", "**/IndexedDB/**", "**/Local Storage/leveldb/**", "**/Session Storage/**", "**/Code Cache/**", "**/GPUCache/**", "**/Cache/Cache_Data/**", "**/Profiles/*/cache2/**", "**/Profile */Cache/**", "**/Default/Cache/**", "**/.mozilla/firefox/*/cache2/**", "**/Library/Caches/com.apple.Safari/**")),
    "app-caches": ((), ("**/Steam/steamapps/shadercache/**", "**/Steam/steamapps/downloading/**", "**/Steam/steamapps/temp/**", "**/Spotify/Storage/**", "**/Discord/Cache/**", "**/Discord/Code Cache/**", "**/Discord/GPUCache/**", "**/Adobe/Common/Media Cache/**", "**/Adobe/Common/Media Cache Files/**", "**/Lightroom Catalog Previews.lrdata/**", "**/Office/Containers/Office365ServiceV2/**", "**/Code/Cache/**", "**/Code/CachedData/**", "**/JetBrains/*/caches/**", "**/JetBrains/*/log/**", "**/Slack/Cache/**", "**/Postman/Cache/**", "**/zoom/data/**")),
    "av-signature-databases": ((), ("C:/ProgramData/Microsoft/Windows Defender/Definition Updates/**", "C:/ProgramData/Microsoft/Windows Defender/Scans/**", "**/AppData/Local/Microsoft/Windows Defender Scans/**", "C:/Program Files (x86)/Norton/**/NDB/**", "C:/Program Files/Bitdefender/**/Antivirus/**", "C:/Program Files/Common Files/McAfee/**", "C:/Program Files/ESET/**/Modules/**", "C:/Program Files/Avast/**/setup/**", "C:/Program Files/AVG/**/setup/**", "**/clamav/database/**")),
}
SAFE_DEFAULTS = ("system-libraries", "vcs-internals", "os-system-trees", "av-signature-databases")


def select_packs(enable: list[str] = (), disable: list[str] = (), defaults: bool = True) -> list[str]:
    """Pack names in their own order: the defaults, with some added and some taken away."""
    unknown = set(enable) | set(disable)
    if unknown - set(PACKS):
        raise ValueError(f"unknown packs: {sorted(unknown - set(PACKS))}")
    on = (set(SAFE_DEFAULTS) if defaults else set()) | set(enable)
    return [p for p in PACKS if p in on - set(disable)]


def exclusion_packs(spark: SparkSession) -> DataFrame:
    """The packs as a table: pack, safe_default, kind (extension or path), pattern."""
    rows = [(name, name in SAFE_DEFAULTS, kind, value) for name, lists in PACKS.items() for kind, values in zip(("extension", "path"), lists, strict=True) for value in values]
    return spark.createDataFrame(rows, "pack string, safe_default boolean, kind string, pattern string")


def exclusion_reason(path: Column, packs: list[str], patterns: list[str] = (), extensions: list[str] = ()) -> Column:
    """NULL if the path stays, else custom-pattern, pack-path:<pack>, custom-extension or pack-extension:<pack>.

    Paths are tested before extensions and custom rules before packs; a reason names the pack whose rule applied.
    """
    flat = F.regexp_replace(path, r"\\", "/")
    out = F.when(matches_any(flat, list(patterns), literal_separator=True), "custom-pattern")
    for name in packs:
        if PACKS[name][1]:
            out = out.when(matches_any(flat, list(PACKS[name][1]), literal_separator=True), f"pack-path:{name}")
    ext = extension(path)
    if extensions:
        out = out.when(ext.isin([e.lower().lstrip(".") for e in extensions]), "custom-extension")
    for name in packs:
        if PACKS[name][0]:
            out = out.when(ext.isin(list(PACKS[name][0])), f"pack-extension:{name}")
    return out


def pack_regexes(name: str) -> list[str]:
    """The path patterns of a pack as regexes."""
    return [glob_regex(p, literal_separator=True) for p in PACKS[name][1]]
