"""Where the public tokenizers' files are; they are read in place and never copied."""


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
