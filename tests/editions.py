"""Small edition archives on disk."""

import zipfile
from pathlib import Path

ORG = "Agência Nacional de Transportes Terrestres"


def xml(text):
    return f"<xml><article>\n<p>{text}</p>\r\n</article></xml>"


def archive(folder, name, texts, extra=()):
    path = Path(folder) / name
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w") as z:
        for i, text in enumerate(texts):
            z.writestr(f"{i:04}.{'XML' if i % 2 else 'xml'}", xml(text))
        for member, content in extra:
            z.writestr(member, content)
    return path


def broken(folder, name, content=b"not an archive"):
    path = Path(folder) / name
    path.write_bytes(content)
    return path


def text_of(texts):
    """What an archive reads as."""
    kept = [" ".join(t.split()) for t in texts]
    return "\n\n".join(t for t in kept if t)
