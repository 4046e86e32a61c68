"""The schemas that the engine's operators and sources share."""

from __future__ import annotations

RECORD = "ordinal long, index_time_ns long, selector long, flags int, payload binary, time_domain_id long"
VOLUME = "volume_id string, volume_size long, partition_size long, partition_count long, index_region_size long, max_block_payload long, persistence_quantum long, created_time_ns long"
PARTITIONS = (
    "slot int, generation decimal(20,0), sealed boolean, block_count long, data_bytes long, min_time_ns long, max_time_ns long, flags long, compression int, compression_version int, "
    "record_format_id decimal(20,0), record_format_version int, time_domain_id decimal(20,0), allowed_backward_skew_ns long, allowed_forward_step_ns long"
)
BLOCK_EVENTS = (
    "kind string, partition_slot int, partition_generation decimal(20,0), block_sequence long, record_count long, min_time_ns long, max_time_ns long, flags long, compression int, stored_size long, raw_size long, "
    "physical_offset long, record_format_id decimal(20,0), record_format_version int, time_domain_id decimal(20,0), data binary, detail_code string, detail_message string, event_order long"
)
RECORD_EVENTS = (
    "kind string, partition_slot int, partition_generation decimal(20,0), block_sequence long, record_position long, index_time_ns long, selector decimal(20,0), record_flags int, payload binary, encoded binary, "
    "time_domain_id decimal(20,0), detail_code string, detail_message string, event_order long"
)
