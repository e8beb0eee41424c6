"""Driver-side options for one preparation run."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

# Limits used when the given minimum is not below the maximum.
FALLBACK_MIN_TOKENS = 100
FALLBACK_MAX_TOKENS = 3000

# The chat types an export can hold.
CHAT_TYPES = (
    "personal_chat",
    "private_group",
    "private_supergroup",
    "public_supergroup",
)


def parse_date_limit(text: str | None, now: datetime) -> datetime | None:
    """Date limit as a naive datetime; empty, invalid or future means no limit."""
    if not text:
        return None
    try:
        limit = datetime.fromisoformat(text).replace(tzinfo=None)
    except ValueError:
        return None
    return limit if limit <= now else None


@dataclass(frozen=True)
class PrepConfig:
    """Options of the preparation plan; defaults are those of a submitted request."""

    target_name: str
    system_prompt: str | None = None
    date_limit: str | None = None
    gap_seconds: int = 3600
    min_tokens: int = 300
    max_tokens: int = 800
    delimiter: str = ">>>"
    chat_types: tuple[str, ...] = ("personal_chat",)
    # Also match senders that differ from target_name only by outer whitespace.
    trim_sender: bool = False
    # A chat up to this many messages is folded as one array; cutting an array
    # costs its length per block. Larger chats are cut into ordered segments, so
    # that no task ever holds a whole giant chat.
    whole_chat_rows: int = 10_000
    # The same for the characters of a chat, which bound the row that holds it.
    whole_chat_chars: int = 50_000_000
    # Rows of one segment, which a task holds as one Arrow table.
    rows_per_segment: int = 1_000_000
    # Clock reading against which a future date limit is recognised.
    now: datetime = field(default_factory=datetime.now)

    def __post_init__(self) -> None:
        unknown = set(self.chat_types) - set(CHAT_TYPES)
        if unknown:
            raise ValueError(f"unknown chat types: {sorted(unknown)}")

    @property
    def token_limits(self) -> tuple[int, int]:
        """(minimum, maximum) tokens per block after the sanity reset."""
        if self.min_tokens >= self.max_tokens:
            return FALLBACK_MIN_TOKENS, FALLBACK_MAX_TOKENS
        return self.min_tokens, self.max_tokens

    @property
    def since(self) -> datetime | None:
        return parse_date_limit(self.date_limit, self.now)

    @property
    def line_prefix(self) -> str:
        return self.delimiter.strip()

    @property
    def system_text(self) -> str | None:
        """System prompt without outer whitespace, None when nothing is left."""
        return (self.system_prompt or "").strip() or None


# The default fine-tuning parameters recorded with every run.
@dataclass(frozen=True)
class FineTuneConfig:
    """Training parameters that travel with the data as run metadata."""

    model_name: str = "unsloth/Llama-3.2-3B-Instruct-bnb-4bit"
    max_seq_length: int = 2048
    load_in_4bit: bool = True
    chat_template: str = "llama-3.2"
    dataset_split: str = "train"
    dataset_num_proc: int = 2
    lora_r: int = 16
    lora_alpha: int = 16
    lora_dropout: int = 0
    lora_bias: str = "none"
    use_gradient_checkpointing: str = "unsloth"
    random_state: int = 3407
    use_rslora: bool = False
    target_modules: tuple[str, ...] = (
        "q_proj",
        "k_proj",
        "v_proj",
        "o_proj",
        "gate_proj",
        "up_proj",
        "down_proj",
    )
    batch_size: int = 2
    gradient_accumulation_steps: int = 4
    warmup_steps: int = 5
    max_steps: int = 60
    learning_rate: float = 2e-4
    weight_decay: float = 0.01
    lr_scheduler_type: str = "linear"
    seed: int = 3407
    packing: bool = False
