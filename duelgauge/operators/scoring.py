"""User-supplied scorers and position replay: the two places where Python sees game rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelgauge import schemas

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def game_moves(moves: DataFrame) -> DataFrame:
    """One row per game with its moves in order."""
    packed = F.sort_array(F.collect_list(F.struct("ply", "move")))
    return moves.groupBy("game_id").agg(F.transform(packed, lambda m: m["move"]).alias("moves"))


def score_games(games: DataFrame, scorer: Scorer, schema: T.StructType = schemas.MOVE_SCORES) -> DataFrame:
    """Run a scorer over Arrow batches of (game_id, moves); it yields one row per move.

    The scorer is called once per task, so a model is loaded once; the batch size is
    spark.sql.execution.arrow.maxRecordsPerBatch. Store the result as a table and reuse it.
    """
    return games.select("game_id", "moves").mapInPandas(scorer, schema)


def side_means(move_scores: DataFrame) -> DataFrame:
    """Per game and side: mean score and number of moves."""
    return move_scores.groupBy("game_id", "color").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("moves"))


START = b"RNBQKBNR" + b"P" * 8 + b" " * 32 + b"p" * 8 + b"rnbqkbnr"
OCCUPANCY_COLUMNS = schemas.OCCUPANCY.fieldNames()


def _square(text: str) -> int:
    return ord(text[0]) - 97 + 8 * (int(text[1]) - 1)


def apply_move(board: bytearray, move: str, white: bool) -> bool:
    """Apply one move in place; False when the moving piece is missing or on the wrong side.

    A king that takes its own rook castles, a pawn stepping aside onto an empty square takes the
    pawn it passed, and a pawn reaching the last rank without a suffix becomes a knight.
    """
    source, target = _square(move), _square(move[2:])
    piece, met = chr(board[source]), chr(board[target])
    if piece == " " or piece.isupper() != white:
        return False
    space = ord(" ")
    board[source] = space
    if piece in "Kk" and met == ("R" if white else "r"):
        rank, short = source - source % 8, target > source
        board[target] = space
        board[rank + (6 if short else 2)] = ord(piece)
        board[rank + (5 if short else 3)] = ord(met)
        return True
    if piece in "Pp":
        if met == " " and source % 8 != target % 8:
            board[source - source % 8 + target % 8] = space
        if target // 8 in (0, 7):
            promoted = move[4:5] or "n"
            piece = promoted.upper() if white else promoted.lower()
    board[target] = ord(piece)
    return True


def _masks(boards: list[bytes]) -> dict[str, np.ndarray]:
    """Occupancy masks of many boards at once."""
    cells = np.frombuffer(b"".join(boards), dtype=np.uint8).reshape(-1, 64)
    pack = lambda chosen: np.packbits(chosen, axis=1, bitorder="little").view(np.int64)[:, 0]
    upper = (cells >= ord("A")) & (cells <= ord("Z"))
    folded = cells & 0xDF
    return {
        "white": pack(upper),
        "black": pack(cells >= ord("a")),
        "kings": pack(folded == ord("K")),
        "pawns": pack(folded == ord("P")),
    }


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys, boards = [], []
        for game_id, moves in zip(batch["game_id"], batch["moves"]):
            board = bytearray(START)
            for ply, move in enumerate(moves):
                good = apply_move(board, move, ply % 2 == 0)
                keys.append((game_id, ply, None if good else "illegal_move_replay"))
                boards.append(bytes(board))
                if not good:
                    break
        if keys:
            frame = pd.DataFrame(keys, columns=["game_id", "ply", "problem"]).assign(**_masks(boards))
            yield frame[OCCUPANCY_COLUMNS]


def replay_positions(games: DataFrame) -> DataFrame:
    """Occupancy masks after every ply of (game_id, moves); a broken game ends in a row with a problem."""
    return games.select("game_id", "moves").mapInPandas(_replay, schemas.OCCUPANCY)


def split_replay(replayed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positions of clean games, and the broken games with their reason."""
    broken = replayed.filter("problem IS NOT NULL").select("game_id", F.col("problem").alias("reason"))
    clean = replayed.drop("problem").join(broken.select("game_id"), "game_id", "left_anti")
    return clean, broken
