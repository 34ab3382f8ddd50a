import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from veilscan.llm import token_files
from veilscan.llm import words as W


def test_ids_of_units_of_many_ids_and_of_bytes_beyond_ascii():
    """Ids are taken from those of the distinct units, whose bytes are spelled by one table."""
    path = public_tokenizers.path(token_files.TOKENIZER)
    texts = ["", "Éàü straße zzzxqjkwv", "a¡¬­®ÿ", " \n", "zzzxqjkwv zzzxqjkwv don't 12345", "中文 ﬂ", ""]
    words = token_files.Words(path)
    assert words._table == "".join(words._mapped.get(b, chr(b)) for b in range(256))
    ids, at = token_files.encode_slice(words, *W.texts(pa.array(texts)), token_files.END)
    library = Tokenizer.from_file(path)
    wanted = [[*library.encode(t, add_special_tokens=False).ids, token_files.END] for t in texts]
    assert [list(map(int, ids[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)] == wanted
    assert ids.dtype == np.dtype("<u4")
