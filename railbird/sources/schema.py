"""Column types of the racing tables.  Times of day are texts (HH:mm:ss)."""

from __future__ import annotations

SCHEMAS = {
    "tracks": "track_code string, track_name string, location string, timezone string",
    "horses": "horse_id string, horse_name string, color string, sex string, foaling_year int, sire string, dam string",
    "races": "race_id string, race_key string, track_code string, race_date date, race_number int, post_time string, race_type string, surface string, distance string, distance_feet int, purse string, "
    "race_status string, is_cancelled boolean, cancellation_reason string, final_time string, fractional_times array<string>, winner_program_number string",
    "race_entries": "entry_id string, race_id string, program_number string, horse_id string, jockey_id string, trainer_id string, owner_id string, post_position int, morning_line_odds string, final_odds string, "
    "scratched boolean, weight int, medication string, equipment string, finish_position int, win_payout decimal(10,2), place_payout decimal(10,2), show_payout decimal(10,2)",
    "changes": "change_id string, race_id string, entry_id string, change_type string, description string, created_at timestamp",
    "claims": "claim_id string, race_id string, horse_name string, program_number string, new_trainer_name string, new_owner_name string, claim_price decimal(12,2)",
    "exotic_payouts": "race_id string, wager_type string, winning_combination string, base_bet decimal(10,2), payout decimal(12,2)",
    "bets": "bet_id string, race_id string, horse_number string, bet_type string, bet_amount decimal(10,2), bet_cost decimal(10,2), selection string, status string, payout decimal(10,2), created_at timestamp",
    "wallets": "wallet_id string, user_ref string, balance decimal(12,2)",
    "transactions": "wallet_id string, amount decimal(12,2), transaction_type string, reference_id string, created_at timestamp",
    "upload_logs": "upload_id string, file_name string, status string, logged_at timestamp, races_extracted int, entries_extracted int, error string",
    "crawl_logs": "run_id string, started_at timestamp, status string, races_found int, races_inserted int, races_failed int, duration_seconds double",
}
KEYS = {
    "tracks": ("track_code",),
    "races": ("race_key",),
    "race_entries": ("race_id", "program_number"),
    "claims": ("race_id", "horse_name"),
    "changes": ("race_id", "entry_id", "change_type"),
}
